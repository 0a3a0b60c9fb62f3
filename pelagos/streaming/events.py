"""Structured Streaming operators; each works on a batch of the same rows too unless it says otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New JSON-lines files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def tumbling(events: DataFrame, time: str, width: str, by: list[str], late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sliding(events: DataFrame, time: str, width: str, slide: str, by: list[str], late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width, slide).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    grouped = rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def latest_by(messages: DataFrame, key: str, order: str) -> DataFrame:
    """The message of each key that arrived last (by its number, not its time)."""
    rest = [c for c in messages.columns if c != key]
    return messages.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("m")).select(key, *[f"m.{c}" for c in rest])


def quota(events: DataFrame, by: str, time: str, limit: int, period: str = "1 day") -> DataFrame:
    """Use per key and period, and whether it is over the limit."""
    used = events.groupBy(by, F.window(time, period).alias("w")).agg(F.count("*").alias("used"))
    return used.select(by, F.col("w.start").alias("period"), "used", (F.col("used") > limit).alias("over"))


def once_within(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Repeats of a key within the watermark are dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def _limited(calls: int, period: float):
    """Whether a row is accepted, given the times of accepted rows, which are kept up to date."""

    def step(t: float, held: list[float]) -> bool:
        while held and held[0] <= t - period:
            held.pop(0)
        if len(held) < calls:
            held.append(t)
            return True
        return False

    return step


def _spaced(gap: float):
    def step(t: float, held: list[float]) -> bool:
        if held and t - held[0] < gap:
            return False
        held[:] = [t]
        return True

    return step


def _per_key(events: DataFrame, key: str, time: str, step, pause: float) -> DataFrame:
    """Adds ``accepted``: rows of each key in time order through ``step(time, held)``.

    A stream keeps ``held`` as state. A batch deals a key out by its pauses: after ``pause`` seconds without a row the
    steps forget, so each stretch between pauses stands alone, and a key with very many rows is many stretches. Sorted
    partitions are read row by row; no stretch is gathered.
    """
    columns = events.columns
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + ", accepted boolean"

    def stateful(_key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for rows in frames:
            rows = rows.sort_values(time, kind="stable")
            yield rows[columns].assign(accepted=[step(t.timestamp(), held) for t in rows[time]])
        state.update((held,))

    if events.isStreaming:
        return events.groupBy(key).applyInPandasWithState(stateful, out_schema, "held array<double>", "append", GroupStateTimeout.NoTimeout)

    place = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            accepted = []
            keys, stretches, times = (batch.column(i).to_pylist() for i in (columns.index(key), place, place + 1))
            for k, s, t in zip(keys, stretches, times, strict=True):
                if (k, s) != last:
                    last, held = (k, s), []
                accepted.append(step(t / 1e6, held))
            yield pa.record_batch([*batch.columns[:place], pa.array(accepted, pa.bool_())], [*columns, "accepted"])

    micros = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(time)
    fresh = F.coalesce((micros - F.lag(micros).over(w) >= int(pause * 1e6)).cast("int"), F.lit(0))
    marked = events.withColumn("__fresh", fresh).withColumn("__stretch", F.sum("__fresh").over(w)).withColumn("__at", micros)
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ties = [c for c in columns if c.endswith("_id") and c != key]
    dealt = marked.repartition(n, key, "__stretch").sortWithinPartitions(key, "__stretch", time, *ties)
    return dealt.select(*columns, "__stretch", "__at").mapInArrow(run, out_schema)


def rate_limit(events: DataFrame, key: str, time: str, calls: int, period: float) -> DataFrame:
    """Adds ``accepted``: at most ``calls`` accepted rows of a key in any ``period`` seconds; rejected ones do not count."""
    return _per_key(events, key, time, _limited(calls, period), period)


def debounce(events: DataFrame, key: str, time: str, gap: float) -> DataFrame:
    """Adds ``accepted``: rows at least ``gap`` seconds after the last accepted row of their key."""
    return _per_key(events, key, time, _spaced(gap), gap)


def upsert(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str):
    """Writes each micro-batch as versions of its keys (see ``operators.storage.latest``), the last of a batch only."""

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("v")).select(*keys, *[f"v.{c}" for c in rest])
        last.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def progress(updates: DataFrame, key: str = "audit_id") -> DataFrame:
    """Per audit: findings and finished tools so far, the last state and whether it has ended (a running aggregate)."""
    return updates.groupBy(key).agg(
        F.sum(F.coalesce("found", F.lit(0))).alias("findings"), F.count_if(F.col("event") == "tool_completed").alias("tools_done"), F.max_by("event", "seq").alias("last_event"),
        F.bool_or(F.col("event").isin("completed", "failed")).alias("ended"),
    )


def retraining_due(feedback: DataFrame, key: str, least: int) -> DataFrame:
    """Models whose queue of feedback is long enough to train again."""
    return feedback.groupBy(key).agg(F.count("*").alias("queued")).withColumn("due", F.col("queued") >= least)


def published(messages: DataFrame, types: list[str], kind: str = "context_type") -> DataFrame:
    """Messages of the types that a subscriber asked for."""
    return messages.where(F.col(kind).isin(types))
