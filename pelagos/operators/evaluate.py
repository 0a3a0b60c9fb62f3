"""Evaluation against ground truth, and statistics of evaluations."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions import scalars as S


def confusion(rows: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn and the rates made of them; a rate without cases is 0."""
    counts = [F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn")]
    out = rows.groupBy(*(by or [])).agg(*counts)
    precision, recall = S.ratio(F.col("tp"), F.col("tp") + F.col("fp")), S.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.select(
        *(by or []), "tp", "fp", "fn", "tn", F.bround(precision, 6).alias("precision"), F.bround(recall, 6).alias("recall"), F.bround(S.f1(precision, recall), 6).alias("f1"),
        F.bround(S.ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6).alias("accuracy"),
    )


def ranking(rows: DataFrame, query: str, rank: str, relevance: str) -> DataFrame:
    """Per query: reciprocal rank, DCG, normalized DCG and average precision of relevances in rank order."""
    gain = F.col(relevance) / F.log2(F.col(rank) + 1)
    ideal = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(relevance)))
    hits = F.sum((F.col(relevance) > 0).cast("int")).over(Window.partitionBy(query).orderBy(rank))
    rated = rows.withColumns({"ideal": ideal, "hits": hits})
    found = rated.groupBy(query).agg(
        F.coalesce(1 / F.min(F.when(F.col(relevance) > 0, F.col(rank))), F.lit(0.0)).alias("rr"),
        F.sum(gain).alias("dcg"),
        F.sum(F.col(relevance) / F.log2(F.col("ideal") + 1)).alias("idcg"),
        F.sum(F.when(F.col(relevance) > 0, F.col("hits") / F.col(rank)).otherwise(0.0)).alias("precisions"),
        F.count_if(F.col(relevance) > 0).alias("relevant"),
    )
    return found.select(
        query, F.bround("rr", 6).alias("rr"), F.bround("dcg", 6).alias("dcg"), F.bround(S.ratio(F.col("dcg"), F.col("idcg")), 6).alias("ndcg"),
        F.bround(S.ratio(F.col("precisions"), F.col("relevant")), 6).alias("ap"),
    )


def _mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    """Two-sided p of discordant counts: exact binomial under 25, else chi-square with continuity correction."""

    def p(b: int, c: int) -> float:
        n = b + c
        if n == 0:
            return 1.0
        if n < 25:
            return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n)
        return math.erfc(math.sqrt((abs(b - c) - 1) ** 2 / n / 2))

    return pd.Series([p(int(x), int(y)) for x, y in zip(b, c, strict=True)], dtype=float)


def mcnemar(rows: DataFrame, on: Column, off: Column, by: list[str] | None = None) -> DataFrame:
    counts = rows.groupBy(*(by or [])).agg(
        F.count_if(on & off).alias("a"), F.count_if(on & ~off).alias("b"), F.count_if(~on & off).alias("c"), F.count_if(~on & ~off).alias("d")
    )
    return counts.withColumn("p_value", F.bround(F.pandas_udf(_mcnemar_p, "double")("b", "c"), 6))


def spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample deviation over runs; 0 for one run."""
    return rows.groupBy(*by).agg(F.bround(F.avg(value), 6).alias("mean"), F.bround(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("sd"), F.count("*").alias("n"))


def regressions(current: DataFrame, baseline: DataFrame, threshold: float, lower_is_better: tuple[str, ...]) -> DataFrame:
    """``metric`` by ``metric``: relative change and whether it is a regression, an improvement or neither."""
    both = current.withColumnRenamed("value", "now").join(baseline.withColumnRenamed("value", "base"), "metric").where("base > 0")
    change = (F.col("now") - F.col("base")) / F.col("base")
    worse = F.when(F.col("metric").isin(*lower_is_better), change).otherwise(-change)
    state = F.when(worse > threshold, "regression").when(worse < -threshold, "improvement").otherwise("ok")
    return both.select("metric", F.bround(change, 6).alias("change"), state.alias("state"))
