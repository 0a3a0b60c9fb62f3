"""Vectors of source code, made without training and without a vocabulary.

Runs of one to three tokens of the masked code are hashed to a dimension and a sign; counts of structures have dimensions
of their own. Neither depends on any other document or on an order of words, so equal code has equal vectors wherever it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos import session
from pelagos.operators import code, lexer

#: Counts with a dimension each, in this order: what they count in masked code.
STRUCTURE = {
    "functions": r"\bfunction\s+\w+", "modifiers": r"\bmodifier\s+\w+", "events": r"\bevent\s+\w+", "requires": r"\brequire\s*\(", "asserts": r"\bassert\s*\(", "emits": r"\bemit\s+\w+",
    "loops": r"\b(?:for|while|do)\b", "conditions": r"\bif\s*\(", "calls out": r"\.(?:call|delegatecall|staticcall)\s*[({]", "sends": r"\.(?:send|transfer)\s*\(",
    "ends": r"\b(?:selfdestruct|suicide)\b", "origins": r"\btx\.origin\b", "assembly": r"\bassembly\b", "unchecked": r"\bunchecked\b", "guards": r"\bnonReentrant\b", "owners": r"\bonly[A-Z]\w*",
    "pauses": r"\bwhenNotPaused\b", "safe sums": r"\bSafeMath\b", "payable": r"\bpayable\b", "views": r"\b(?:view|pure)\b", "mappings": r"\bmapping\s*\(", "structs": r"\bstruct\b", "clocks": r"\bblock\.(?:timestamp|number)\b",
    "senders": r"\bmsg\.sender\b",
}
DIMENSIONS, LONGEST = 128, 3


def _place(run: Column, buckets: int) -> tuple[Column, Column]:
    """Dimension and sign of a run of tokens, from its digest."""
    digest = F.md5(run.cast("binary"))
    number = lambda at: F.conv(F.substring(digest, at, 7), 16, 10).cast("long")
    return number(1) % buckets, 1 - 2 * (number(8) % 2)


def _runs(longest: int) -> Column:
    """Runs of one to ``longest`` tokens that begin at place ``i`` of the list ``t``; null where it has ended."""
    token = lambda k: F.get("t", F.col("i") + k)
    return F.array(*[F.concat(token(0), *[x for k in range(1, n) for x in (F.lit(" "), token(k))]) for n in range(1, longest + 1)])


def code_vectors(docs: DataFrame, key: str = "doc_id", text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """``(key, vector)`` of length one, or zero where there is no code: structure counts first, then hashed runs, each as the
    signed logarithm of one and the count. Rows of one key are one document.

    Documents are dealt by key once, before they are cut up: sums by key and dimension and vectors by key then stay in their
    task, and no run is shuffled.
    """
    buckets = dimensions - len(STRUCTURE)
    plain = session.spread(docs.select(key, text), key).select(key, F.coalesce(lexer.masked(F.col(text)), F.lit("")).alias("code"))
    tokens = plain.select(key, "code", F.regexp_extract_all("code", F.lit(code.TOKEN), F.lit(0)).alias("t"))
    place, sign = _place(F.col("run"), buckets)
    begun = tokens.select(key, "t", F.explode(F.sequence(F.lit(0), F.size("t"))).alias("i"))
    hashed = begun.select(key, F.explode(_runs(LONGEST)).alias("run")).where("run is not null").select(key, (place + len(STRUCTURE)).alias("dim"), sign.alias("n"))
    counts = [F.regexp_count("code", F.lit(p)).cast("long") for p in STRUCTURE.values()]
    counted = plain.select(key, F.posexplode(F.array(*counts, *[F.lit(0).cast("long")] * buckets)).alias("dim", "n"))  # a row for every dimension
    sums = hashed.unionByName(counted).groupBy(key, "dim").agg(F.sum("n").alias("n"))
    weight = F.signum("n") * F.log1p(F.abs("n"))
    parts = sums.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("dim", weight.alias("w")))).alias("w"))  # `dimensions` entries
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x))
    raw = parts.select(key, F.transform("w", lambda x: x["w"]).alias("raw")).select(key, "raw", length.alias("length"))  # once, not per component
    return raw.select(key, F.when(F.col("length") > 0, F.transform("raw", lambda x: x / F.col("length"))).otherwise(F.col("raw")).alias("vector"))
