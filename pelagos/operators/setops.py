"""Set operations on collections of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_sets(detected: DataFrame, truth: DataFrame, by: str, item: str) -> DataFrame:
    """Per ``by``: how many items are in both, detected only, in the truth only."""
    d = detected.select(by, item).distinct().withColumn("d", F.lit(1))
    t = truth.select(by, item).distinct().withColumn("t", F.lit(1))
    both = d.join(t, [by, item], "full_outer")
    return both.groupBy(by).agg(
        F.count_if(F.col("d").isNotNull() & F.col("t").isNotNull()).alias("matched"),
        F.count_if(F.col("t").isNull()).alias("extra"),
        F.count_if(F.col("d").isNull()).alias("missed"),
    )


def coverage_histogram(rows: DataFrame, key: list[str], provider: str) -> DataFrame:
    """How many keys one provider found, two, three, ..."""
    per = rows.groupBy(*key).agg(F.count_distinct(provider).alias("providers"))
    return per.groupBy("providers").agg(F.count("*").alias("n_keys"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of several sources; columns that one lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
