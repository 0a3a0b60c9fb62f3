"""Predicates that label or drop findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions import scalars as S


def min_confidence(findings: DataFrame, threshold: float) -> DataFrame:
    """Rows of at least that confidence; a missing one counts 1, a threshold of 0 or less keeps all."""
    return findings if threshold <= 0 else findings.where(F.coalesce("confidence", F.lit(1.0)) >= threshold)


def min_confidence_nested(results: DataFrame, threshold: float, column: str = "findings") -> DataFrame:
    """The same inside arrays of findings, without exploding them."""
    return results.withColumn(column, F.filter(column, lambda f: F.coalesce(f["confidence"].try_cast("double"), F.lit(1.0)) >= threshold))


def split(findings: DataFrame, confidence: float, fp: float) -> DataFrame:
    """Adds ``outcome``: kept, filtered (too likely false) or below (too little confidence, in neither list)."""
    return findings.withColumn("outcome", F.when(F.col("confidence") < confidence, "below").when(F.col("fp") >= fp, "filtered").otherwise("kept"))


def diminishing(matches: Column) -> Column:
    """Evidence that counts less each time: the matches in falling order, weighted 1, 1/2, 1/3, ..., at most 0.95."""
    ordered = F.reverse(F.array_sort(matches))
    weighed = F.aggregate(F.transform(ordered, lambda x, i: x / (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return F.least(F.lit(0.95), weighed)


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n (0 for none): summed for small n, else by its expansion, right to some 1e-12."""
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(20)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / i)
    x = n.cast("double")
    large = F.ln(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return F.when(n <= 0, 0.0).when(n <= 20, small).otherwise(large)


def diminishing_per(matches: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``(keys, evidence)``: as ``diminishing`` over the matches of each key, whose weights are a few different ones. Matches
    are counted per weight; a run of equal weights from place a + 1 to b adds weight * (H(b) - H(a)), so no key is gathered."""
    counted = matches.groupBy(*keys, weight).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc(weight)))  # a row a weight
    share = F.col(weight) * (harmonic(F.col("upto")) - harmonic(F.col("upto") - F.col("n")))
    return counted.withColumn("upto", upto).groupBy(*keys).agg(F.least(F.lit(0.95), F.sum(share)).alias("evidence"))


def additive(findings: DataFrame, signals: dict[str, tuple[Column, float]], threshold: float, confirmations: Column | None = None) -> DataFrame:
    """Additive false-positive score of the signals that hold, less for confirmed findings, at most 0.95; rows under
    ``threshold`` are kept and their confidence scaled by what is left."""
    score = sum((F.when(c, w).otherwise(0.0) for c, w in signals.values()), F.lit(0.0))
    if confirmations is not None:
        score = score - F.when(confirmations >= 3, 0.3).when(confirmations == 2, 0.15).otherwise(0.0)
    out = findings.withColumn("fp", F.bround(F.least(F.lit(0.95), F.greatest(F.lit(0.0), score)), 6))
    return out.where(F.col("fp") < threshold).withColumn("confidence", F.bround(F.col("confidence") * (1 - F.col("fp")), 6))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, null if none: annotates, does not drop."""
    return F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules])


def gate(findings: DataFrame, by: list[str], floor: str, ranks: dict[str, int]) -> DataFrame:
    """Whether any finding of a group is at least as severe as ``floor``."""
    rank = S.lookup(ranks, F.lower("severity"), 0)
    return findings.groupBy(*by).agg(F.bool_or(rank >= ranks[floor]).alias("fails"), F.count_if(rank >= ranks[floor]).alias("n_failing"))


def in_range(findings: DataFrame, first: int, last: int) -> DataFrame:
    return findings.where(F.col("line").between(first, last))


def grep(lines: DataFrame, pattern: str, limit: int) -> DataFrame:
    """First ``limit`` matching lines in order of document and line; each task keeps only its own first ones."""
    return lines.where(F.col("line").rlike(f"(?i){pattern}")).orderBy("doc_id", "line_no").limit(limit)
