"""Mixing sources to target weights: repeat rates from aggregated sizes, whole copies plus one Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.llm import common


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the document's id alone, so reruns and every engine agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, ceiling: float) -> DataFrame:
    """``(source, source_size, target)`` of ``sizes(source, size)``: ``share`` of all sizes dealt by weight, no target
    above ``ceiling`` times its source's size, what is above dealt again by weight among the rest until none is.

    Sources are ordered by code point, null last, and take ``weights`` in turn. One row per source is kept in Spark;
    each round brings two sums to the driver, and a round ends the filling or caps at least one more source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = common.ordered_index(per, [F.col("source").asc_nulls_last()])
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = common.materialize(
        ranked.select("source", "source_size", F.element_at(cycle, (F.col("idx") % len(weights) + 1).cast("int")).alias("weight")), "sources"
    )
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    cap = F.lit(ceiling) * F.col("source_size")
    level = 0.0
    while True:
        above = F.col("weight") * F.lit(level) > cap
        capped, free = ranked.agg(F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if not free:
            break
        new = (share * total - capped) / free
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)


def _copies(rate: Column, doc_id: Column, seed: int) -> Column:
    return F.floor(rate).cast("long") + (draw(doc_id, seed) < rate - F.floor(rate)).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    sizes = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    return common.materialize(sizes, "sizes")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0, seed: int = 20240229) -> DataFrame:
    """Per row of ``docs(doc_id, text, source)``: ``doc_id, source, size, source_size, target, copies``.

    ``copies`` is floor(rate) plus one with probability the fraction, rate = target / source_size, drawn from the
    doc_id: rerun or re-partitioned, the mix is the same. Null text has size 0, null source is a source of its own,
    rows with one doc_id share their draw, an empty table gives no rows, other columns are ignored. A source without
    words has target 0 and no copies. A source that holds most rows is summed before the shuffle and its one row is
    joined back, so it is never gathered.
    """
    sizes = _sized(docs)
    targets = source_targets(sizes, weights, share, ceiling).withColumnRenamed("source", "of_source")
    joined = sizes.join(targets, F.col("source").eqNullSafe(F.col("of_source")))
    return joined.select("doc_id", "source", "size", "source_size", "target", _copies(_rate(), F.col("doc_id"), seed).alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0, seed: int = 20240229) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (0 times: left out); nulls and ties as in ``mix``."""
    targets = source_targets(_sized(docs), weights, share, ceiling)
    rates = targets.select(F.col("source").alias("of_source"), _rate().alias("rate"))
    taken = docs.select(common.packed(docs)).join(rates, F.col("row.source").cast("string").eqNullSafe(F.col("of_source")))
    copies = F.array_repeat(F.lit(0), _copies(F.col("rate"), F.col("row.doc_id"), seed).cast("int"))
    return taken.select("row", F.explode(copies).alias("copy")).select(*common.unpacked(docs))
