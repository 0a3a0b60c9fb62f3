"""Grouping and deduplication of findings: by buckets, by votes, by similarity."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos import schema, session
from pelagos.functions import scalars as S


def noisy_or(weight: Column) -> Column:
    """1 - product(1 - w), at most 0.99; a tool that reports twice counts twice."""
    return F.least(F.bround(1 - F.product(1 - weight), 3), F.lit(0.99))


def semantic(findings: DataFrame, width: int = 15) -> DataFrame:
    """One row per category, file, function and bucket of ``width`` lines.

    The representative is the most severe row, first by ``ord`` among equals; confidence is noisy-or over the
    rows' tools. Everything is a combinable aggregate, so hot keys are reduced before the shuffle.
    """
    rank = S.lookup(schema.SEVERITY_ORDER, F.lower("severity"), 0)
    rows = findings.select(
        "*",
        S.category(F.col("type")).alias("category"),
        S.bucket(F.col("line"), width).alias("line_bucket"),
        S.lookup(schema.TOOL_WEIGHT, F.col("tool"), 0.5).alias("weight"),
        F.struct(rank.alias("rank"), (-F.col("ord")).alias("neg_ord")).alias("pick"),
    )
    return rows.groupBy("category", "file", "function", "line_bucket").agg(
        noisy_or(F.col("weight")).alias("confidence"),
        F.max_by(F.struct("ord", "tool", "severity", "type", "line", "message"), "pick").alias("best"),
        F.array_sort(F.collect_set("tool")).alias("tools"),
        S.few_distinct(F.col("tool")).alias("tool_count"),
        F.count("*").alias("n_findings"),
    )


def exact(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Identical findings from several tools to one: the tools in order of arrival, how many rows went. Rows are counted per
    key and tool first, so that what is gathered of a key are its few tools, however many rows it has."""
    once = findings.groupBy(*keys, "tool").agg(F.min("ord").alias("ord"), F.count("*").alias("n"))
    return once.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "tool"))), lambda x: x["tool"]).alias("tools"),
        F.min("ord").alias("first_ord"),
        (F.sum("n") - 1).alias("collapsed"),
    )


def merged_with_evidence(findings: DataFrame, width: int = 15) -> DataFrame:
    """``semantic`` with ``evidence``: the first message of each tool of a group, in order of arrival; a group has as many as
    it has tools, not as it has rows."""
    keys = ["category", "file", "function", "line_bucket"]
    placed = findings.select("ord", "tool", "message", "file", "function", S.category(F.col("type")).alias("category"), S.bucket(F.col("line"), width).alias("line_bucket"))
    said = placed.groupBy(*keys, "tool").agg(F.min(F.struct("ord", "message")).alias("m")).groupBy(*keys)
    evidence = said.agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["message"]).alias("evidence"))
    merged = semantic(findings, width)
    on = [merged[k].eqNullSafe(evidence[k]) for k in keys]
    return merged.join(evidence, on).select(*[merged[c] for c in merged.columns], "evidence")


def merge_statistics(merged: DataFrame) -> DataFrame:
    """One row: findings before and after merging, how many went, their share, groups of several tools."""
    n = F.coalesce(F.sum("n_findings"), F.lit(0))
    share = F.when(n > 0, F.bround((n - F.count("*")) / n, 6)).otherwise(0.0)
    return merged.agg(n.alias("original"), F.count("*").alias("merged"), (n - F.count("*")).alias("removed"), share.alias("reduction"), F.count_if(F.col("tool_count") > 1).alias("cross_tool"))


def first_per(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first row of each key by ``order`` (different within a key): an aggregate, not a window, so it is combined before
    the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[(F.min(c) if c == order else F.min_by(c, order)).alias(c) for c in rest])


def votes(findings: DataFrame, models: int, strategy: str = "majority", threshold: int = 2, width: int = 5) -> DataFrame:
    """Ensemble voting: one vote per model and signature (type, function, line bucket; not the file).

    ``passes`` by majority (more than half), unanimity, a fixed number, or half of the weight of all models.
    """
    signed = findings.withColumn("bucket", S.bucket(F.col("line"), width))
    once = first_per(signed.select("type", "function", "bucket", "tool", "ord", "confidence"), ["type", "function", "bucket", "tool"])
    weight = S.lookup(schema.TOOL_WEIGHT, F.col("tool"), 0.5)
    total = once.select("tool").distinct().agg(F.sum(weight).alias("total_weight"))
    grouped = once.groupBy("type", "function", "bucket").agg(
        F.count("*").alias("votes"), F.sum(weight).alias("weighted"), F.avg(F.coalesce("confidence", F.lit(0.7))).alias("mean_confidence")
    )
    passes = {
        "majority": F.col("votes") > models / 2,
        "unanimous": F.col("votes") == models,
        "threshold": F.col("votes") >= threshold,
        "weighted": F.col("weighted") >= F.col("total_weight") * 0.5,
    }[strategy]
    bonus = F.least(F.lit(0.2), F.col("votes") * 0.05)
    return grouped.join(F.broadcast(total)).select(  # one row
        "type", "function", "bucket", "votes", F.least(F.lit(0.99), F.col("mean_confidence") + bonus).alias("confidence"), passes.alias("passes")
    )


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def similarity(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of two messages in lower case; for pairs that a band join has left over."""
    return F.pandas_udf(_ratios, "double")(a, b)


#: Character classes that are counted for the bound: letters and digits two by two, all others by their code point.
_CLASSES = 40


def letter_counts(text: Column) -> Column:
    """How often a text in lower case has characters of each of ``_CLASSES`` classes."""
    classes = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), ""), lambda c: F.when(c == "", -1).otherwise(F.ascii(c) % _CLASSES))
    return F.transform(F.sequence(F.lit(0), F.lit(_CLASSES - 1)), lambda k: F.size(F.filter(classes, lambda c: c == k)))


def ratio_bound(a: Column, b: Column) -> Column:
    """The most that the ratio of matching blocks can be, by the letter counts of both texts: twice the characters that
    both have over all characters. Classes hold several characters, which can only raise it."""
    total = lambda counts: F.aggregate(counts, F.lit(0), lambda s, n: s + n)
    common = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, n: s + n)
    both = total(a) + total(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * common / both)


@lru_cache(1 << 14)
def _near(a: str, b: str, least: float) -> bool:
    """Whether the ratio of matching blocks comes to ``least``; lengths and letters are bounds. Messages repeat, so a worker
    remembers the last pairs."""
    blocks = SequenceMatcher(None, a, b)
    return blocks.real_quick_ratio() >= least and blocks.quick_ratio() >= least and blocks.ratio() >= least


def similar(a: Column, b: Column, least: float) -> Column:
    """Whether ``similarity`` of two messages is ``least`` or more."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_near((m or "").lower(), (n or "").lower(), least) for m, n in zip(x, y, strict=True)], dtype=bool)

    return F.pandas_udf(run, "boolean")(a, b)


def near_pairs(findings: DataFrame, tolerance: int = 5, least: float = 0.85) -> DataFrame:
    """Pairs ``(a, b)`` of similar findings, a < b by ``ord``: same file, lines within ``tolerance``, equal functions where
    both have one, and equal category or similar messages.

    A band join: rows meet in buckets of lines and the bucket next to theirs, so no file is compared with itself whole.
    """
    width = tolerance + 1
    base = findings.select("ord", "file", "function", "line", "message", S.category(F.col("type")).alias("category"), F.floor(F.col("line") / width).alias("band"))
    left = base.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step")).withColumn("band", F.col("band") + F.col("step")).drop("step")
    a, b = left.alias("a"), base.alias("b")
    close = (F.col("a.file") == F.col("b.file")) & (F.col("a.band") == F.col("b.band")) & (F.abs(F.col("a.line") - F.col("b.line")) <= tolerance)
    scoped = (F.col("a.function") == F.col("b.function")) | (F.col("a.function") == "") | (F.col("b.function") == "")
    pairs = a.join(b, close & (F.col("a.ord") < F.col("b.ord")) & scoped)
    equal = F.coalesce(F.col("a.category") == F.col("b.category"), F.lit(False))
    ends = F.col("a.ord").alias("a"), F.col("b.ord").alias("b")
    return pairs.where(equal).select(*ends).unionByName(pairs.where(~equal).where(similar(F.col("a.message"), F.col("b.message"), least)).select(*ends))


def greedy(findings: DataFrame, tolerance: int = 5) -> DataFrame:
    """``(ord, group)``: one forward pass per file, category and function, a row joining the first group that has a row
    within ``tolerance`` lines; depends on the order of arrival, as the components of ``near_pairs`` do not.

    A gap of more than ``tolerance`` lines splits a function's rows before Python sees them; sorted partitions are read
    row by row, and what is held are the lines of one such stretch.
    """
    by = ["file", "category", "function"]
    base = findings.select("ord", "file", "function", "line", S.category(F.col("type")).alias("category"))
    w = Window.partitionBy(*by).orderBy("line", "ord")
    gap = F.coalesce((F.col("line") - F.lag("line").over(w) > tolerance).cast("int"), F.lit(0))
    stretch = base.withColumn("gap", gap).withColumn("g", F.xxhash64(*by, F.sum("gap").over(w)))

    def run(batches):
        last, groups = None, []
        for batch in batches:
            out = []
            for g, at, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != last:
                    last, groups = g, []
                found = next((x for x in groups if any(abs(line - n) <= tolerance for n in x[1])), None)
                if found is None:
                    groups.append(found := (at, set()))
                found[1].add(line)
                out.append(found[0])
            yield pa.record_batch([batch.column(1), pa.array(out, pa.int64())], ["ord", "group"])

    n = int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stretch.repartition(n, "g").sortWithinPartitions("g", "ord").select("g", "ord", "line")
    return dealt.mapInArrow(run, "ord long, group long")


def components(pairs: DataFrame, nodes: DataFrame, rounds: int = 60) -> DataFrame:
    """``(ord, group)``: smallest ``ord`` reachable over ``pairs(a, b)``, itself without a pair.

    Stars contract: every node hands its larger neighbours its least one, then its smaller neighbours too, until each
    component is a star around its least node; rounds grow with the logarithm of a component's size. Each is grouped
    minima, combined before the shuffle, and joins on them, cut with a checkpoint. Raises beyond ``rounds``.
    """
    session.ensure_checkpoint_dir(pairs.sparkSession)
    live = pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    seen = None
    for _ in range(rounds):
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pointed = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        live = pointed.select("e.u", "e.v").where("u <> v").distinct().checkpoint()
        now = tuple(live.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = live.groupBy("u").agg(F.min("v").alias("least"))
    return nodes.select("ord").join(found, F.col("ord") == F.col("u"), "left").select("ord", F.coalesce("least", "ord").alias("group"))
