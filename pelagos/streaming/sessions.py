"""Sessions with timers: state per key that ends by an event, or by silence.

A stream holds one open session a key in ``transformWithState`` and sets an event-time timer for when it would have been
silent too long; the timer's firing emits the session and clears the state, so that keys that are gone cost nothing. A
batch of the same rows gives the same sessions with windows per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATES = "session string, began timestamp, last timestamp, steps long, failed_steps long, state string"
#: Times since the epoch in microseconds, which both sides count alike.
HELD = "began long, last long, steps long, failed long"


class Sessions(StatefulProcessor):
    """Emits a session when a terminal event ends it (with that event's state) or when ``silence`` has passed (timed_out)."""

    def __init__(self, time: str, kind: str, order: str, terminal: dict[str, str], failed: str | None, silence: int):
        self.time, self.kind, self.order, self.terminal, self.failed, self.silence = time, kind, order, terminal, failed, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", HELD)

    def _row(self, key: str, held: tuple, state: str) -> dict:
        stamp = lambda t: pd.Timestamp(t, unit="us")
        return {"session": key, "began": stamp(held[0]), "last": stamp(held[1]), "steps": held[2], "failed_steps": held[3], "state": state}

    def _timer(self, held: tuple) -> int:
        return (held[1] + self.silence) // 1000 + 1  # in milliseconds, after the silence is over

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = tuple(self.open.get()) if self.open.exists() else None
        if held:
            self.handle.deleteTimer(self._timer(held))
        out = []
        every = pd.concat(list(rows)).sort_values([self.time, self.order], kind="stable")
        for t, kind in zip(every[self.time], every[self.kind], strict=True):
            at = t.value // 1000
            if held and at - held[1] > self.silence:
                out.append(self._row(key[0], held, "timed_out"))
                held = None
            held = (held[0] if held else at, at, (held[2] if held else 0) + 1, (held[3] if held else 0) + (kind == self.failed))
            if kind in self.terminal:
                out.append(self._row(key[0], held, self.terminal[kind]))
                held = None
        if held:
            self.open.update(held)
            self.handle.registerTimer(self._timer(held))
        elif self.open.exists():
            self.open.clear()
        yield pd.DataFrame(out, columns=[f.split()[0] for f in STATES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = tuple(self.open.get())
        self.open.clear()
        yield pd.DataFrame([self._row(key[0], held, "timed_out")])

    def close(self) -> None:
        pass


def ended(events: DataFrame, key: str, time: str, kind: str, order: str, terminal: dict[str, str], silence: int, failed: str | None = None, late: int = 0) -> DataFrame:
    """``(session, began, last, steps, failed_steps, state)`` of the sessions of ``key`` that have ended: by an event of
    ``terminal`` (state by kind), or after more than ``silence`` seconds without one (timed_out).

    In a stream the watermark is ``late`` seconds behind and needs the RocksDB state store; a batch stands where the
    stream would after all of its rows, so that a session whose silence is not over by then is not among the rows of either.
    """
    micros = silence * 1_000_000
    if events.isStreaming:
        rows = events.select(F.col(key).cast("string").alias(key), F.col(time).cast("timestamp").alias(time), kind, order).withWatermark(time, f"{late} seconds")
        return rows.groupBy(key).transformWithStateInPandas(Sessions(time, kind, order, terminal, failed, micros), STATES, "append", "eventTime")
    w = Window.partitionBy(key).orderBy(time, order)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = events.select(F.col(key).cast("string").alias(key), F.col(time).cast("timestamp").alias(time), kind, order, at.alias("at"))
    ends = F.col(kind).isin(*terminal)
    fresh = F.coalesce((F.col("at") - F.lag("at").over(w) > micros) | F.lag(ends).over(w), F.lit(True))
    numbered = rows.withColumn("fresh", fresh).withColumn("n", F.sum(F.col("fresh").cast("int")).over(w))
    last_kind = F.max_by(kind, F.struct(time, order))
    grouped = numbered.groupBy(key, "n").agg(
        F.min(time).alias("began"), F.max(time).alias("last"), F.count("*").alias("steps"), F.count_if(F.col(kind) == failed if failed else F.lit(False)).alias("failed_steps"), last_kind.alias("kind__"), F.max("at").alias("at")
    )
    named = F.lit("timed_out")
    for k, state in terminal.items():
        named = F.when(F.col("kind__") == k, state).otherwise(named)
    now = rows.agg((F.max("at") - late * 1_000_000).alias("now"))  # one row
    latest = Window.partitionBy(key).orderBy(F.desc("n"))
    judged = grouped.join(F.broadcast(now)).withColumn("newest", F.row_number().over(latest) == 1)
    over = F.col("kind__").isin(*terminal) | ~F.col("newest") | (F.floor((F.col("at") + micros) / 1000) + 1 <= F.floor(F.col("now") / 1000))
    return judged.where(over).select(F.col(key).alias("session"), "began", "last", "steps", "failed_steps", named.alias("state"))


def silent(events: DataFrame, key: str, time: str, order: str, silence: int, late: int = 0) -> DataFrame:
    """``(session, last, steps)``: clients whose heartbeats have stopped for more than ``silence`` seconds, each time again."""
    beats = events.withColumn("beat__", F.lit("beat"))
    return ended(beats, key, time, "beat__", order, {}, silence, None, late).select("session", "last", "steps")
