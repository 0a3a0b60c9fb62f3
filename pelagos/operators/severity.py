"""Severity, effort and remediation from text and context, as sums of expressions over small rule lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.functions import scalars as S

#: Base severity score of categories.
BASE = {"reentrancy": 0.8, "access-control": 0.75, "integer-overflow": 0.6, "unchecked-call": 0.5, "time-manipulation": 0.3}
#: Words in a message that raise it.
IMPACTS = ((r"drain|steal|all funds", 0.2), (r"owner|admin", 0.1), (r"denial|stuck", 0.05))
#: Hours of work by effort.
HOURS = {"trivial": 1, "low": 4, "medium": 16, "high": 40}
EFFORT_FACTOR = {"trivial": 1.5, "low": 1.2, "medium": 1.0, "high": 0.8}


def predict(findings: DataFrame, value_at_risk: Column, open_function: Column) -> DataFrame:
    """Adds ``severity_score`` (0.1 to 1), ``predicted`` and the ``reasons`` that counted."""
    message = F.lower("message")
    parts = [(message.rlike(p), w, p) for p, w in IMPACTS]
    parts += [(value_at_risk > 1_000_000, 0.15, "value"), (open_function, 0.05, "open")]
    base = S.lookup(BASE, S.category(F.col("type")), 0.4)
    score = base + sum((F.when(c, w).otherwise(0.0) for c, w, _ in parts), F.lit(0.0))
    clamped = F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.1), score)), 6)
    reasons = F.filter(F.array(*[F.when(c, F.lit(name)) for c, _, name in parts]), lambda x: x.isNotNull())
    out = findings.withColumns({"severity_score": clamped, "reasons": reasons})
    x = F.col("severity_score")
    return out.withColumn("predicted", F.when(x >= 0.85, "critical").when(x >= 0.65, "high").when(x >= 0.4, "medium").when(x >= 0.2, "low").otherwise("info"))


def effort(category: Column) -> Column:
    return F.when(category.isin("unchecked-call", "time-manipulation"), "low").when(category == "reentrancy", "medium").when(category == "access-control", "trivial").otherwise("high")


def plan(findings: DataFrame, quick_hours: int = 4) -> DataFrame:
    """Adds effort, hours, a priority (severity weight, raised a tenth for each further finding of the category in the
    file, times how easy it is) and whether it is a quick win."""
    category = S.category(F.col("type"))
    weight = S.lookup({"critical": 10.0, "high": 7.0, "medium": 4.0, "low": 2.0, "info": 1.0}, F.lower("severity"), 1.0)
    named = findings.withColumns({"category": category, "effort": effort(category), "weight": weight})
    more = named.groupBy("file", "category").agg((F.count("*") - 1).alias("more"))
    joined = named.join(more, ["file", "category"])
    hours = S.lookup(HOURS, F.col("effort"), 16)
    priority = F.col("weight") * (1 + 0.1 * F.least(F.col("more"), F.lit(5))) * S.lookup(EFFORT_FACTOR, F.col("effort"), 1.0)
    return joined.withColumns({"hours": hours, "priority": F.bround(priority, 6), "quick_win": hours <= quick_hours}).drop("weight", "more")


# The ladders that turn a score into a severity, highest first.
LADDERS = {
    "prediction": ((0.85, "critical"), (0.65, "high"), (0.4, "medium"), (0.2, "low")),
    "classification": ((0.85, "critical"), (0.65, "high"), (0.45, "medium"), (0.25, "low")),
    "cvss": ((9.0, "critical"), (7.0, "high"), (4.0, "medium"), (0.1, "low")),
}
#: Verdicts of provers in one vocabulary.
PROVER_STATUS = {"passed": "verified", "failed": "violated", "error": "error", "timeout": "timeout", "no_tests": "no_tests"}


def by_ladder(score: Column, ladder: str) -> Column:
    """The severity of ``score`` by one of ``LADDERS``; below all steps: info."""
    out = F.lit("info")
    for least, name in reversed(LADDERS[ladder]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def prover_status(status: Column) -> Column:
    """A prover's own word in the common vocabulary; words it lacks stay as they are, none is unavailable."""
    return F.coalesce(S.lookup(PROVER_STATUS, F.lower(F.trim(status)), F.lower(F.trim(status))), F.lit("unavailable"))


def either_contains(name: Column, ladder: tuple[tuple[str, str], ...], default: str) -> Column:
    """Value of the first key of ``ladder`` that the name contains or that contains the name; ``default`` for an empty one."""
    low = F.lower(F.coalesce(name, F.lit("")))
    out = F.lit(default)
    for key, value in reversed(ladder):
        out = F.when((low != "") & (low.contains(key) | F.lit(key).contains(low)), value).otherwise(out)
    return out


# Default impact and ease of exploitation of types, their scores, and words that raise them.
IMPACT_SCORE = {"total": 1.0, "partial": 0.7, "none": 0.3, "note": 0.1}
IMPACT_OF = {
    "bridge-vulnerability": "total", "unprotected-selfdestruct": "total", "arbitrary-send": "total", "reentrancy": "total", "access-control": "partial", "oracle-manipulation": "partial",
    "price-manipulation": "partial", "delegatecall": "partial", "integer-overflow": "partial", "integer-underflow": "partial", "unchecked-call": "none", "front-running": "none",
    "sandwich-attack": "none", "timestamp-dependence": "none", "tx-origin": "none", "gas-optimization": "note", "naming-convention": "note", "code-style": "note",
}
EASE_OF = {
    "access-control": 1.0, "unprotected-selfdestruct": 1.0, "arbitrary-send": 1.0, "reentrancy": 0.6, "oracle-manipulation": 0.6, "unchecked-call": 0.6, "flash-loan-attack": 0.3,
    "governance-attack": 0.3, "front-running": 0.3,
}
WIDE_WORDS = ("all users", "entire protocol", "all funds", "total supply", "all contracts", "protocol-wide", "every", "complete drainage")
CONTRACT_WORDS = ("contract", "balance")
EXPLOIT_WORDS = ("dao hack", "parity", "beanstalk", "wormhole", "ronin", "nomad", "harvest", "bzx", "cream", "mango", "known exploit", "real-world", "historic")
FUND_WORDS = ("eth", "ether", "funds", "balance", "transfer", "withdraw", "token", "erc20", "usdc", "usdt", "dai", "weth", "vault", "treasury", "stake", "deposit")
FACTOR_WEIGHT = {"impact": 0.5, "ease": 0.3, "scope": 0.2}


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def classify(findings: DataFrame, needs_rights: Column) -> DataFrame:
    """Adds ``severity_score`` and ``classified``: impact, ease and scope by weight; 0.15 more for a known exploit, 0.1 more if
    funds are named, 0.1 less if the caller needs rights; each step is kept between 0 and 1."""
    kind, text = F.lower(F.coalesce("type", F.lit(""))), F.lower(F.coalesce("message", F.lit("")))
    impact = S.lookup({k: IMPACT_SCORE[v] for k, v in IMPACT_OF.items()}, kind, IMPACT_SCORE["none"])
    scope = F.when(any_of(text, WIDE_WORDS), 1.0).when(any_of(text, CONTRACT_WORDS), 0.6).otherwise(0.3)
    score = impact * FACTOR_WEIGHT["impact"] + S.lookup(EASE_OF, kind, 0.6) * FACTOR_WEIGHT["ease"] + scope * FACTOR_WEIGHT["scope"]
    score = F.least(F.lit(1.0), score + F.when(any_of(text, EXPLOIT_WORDS), 0.15).otherwise(0.0))
    score = F.least(F.lit(1.0), score + F.when(any_of(text, FUND_WORDS), 0.1).otherwise(0.0))
    score = F.bround(F.greatest(F.lit(0.0), score - F.when(needs_rights, 0.1).otherwise(0.0)), 6)
    return findings.withColumn("severity_score", score).withColumn("classified", by_ladder(F.col("severity_score"), "classification"))


def adjusted_vector(category: Column, severity: Column, vectors: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """The CVSS metrics of a category: those of the first key that contains it or that it contains, else the default ones, which
    follow the severity (critical: no privileges, high integrity and availability impact; high: high integrity impact; low and
    informational: high complexity). A critical finding of a known category has low complexity."""
    name = F.regexp_replace(F.lower(category), "[ _]", "-")
    places = ("av", "ac", "pr", "ui", "c", "i", "a")
    known = either_contains(name, tuple((k, "".join(v)) for k, v in vectors.items()), "")
    low = F.lower(severity)
    default = {
        "av": F.lit("N"), "ac": F.when(low.isin("low", "info", "informational"), "H").otherwise("L"), "pr": F.when(low == "critical", "N").otherwise("L"), "ui": F.lit("N"), "c": F.lit("N"),
        "i": F.when(low.isin("critical", "high"), "H").otherwise("L"), "a": F.when(low == "critical", "H").otherwise("N"),
    }
    own = {p: F.substring(known, i + 1, 1) for i, p in enumerate(places)}
    own["ac"] = F.when(low == "critical", "L").otherwise(own["ac"])
    return {p: F.when(known == "", default[p]).otherwise(own[p]) for p in places}


def effort_class(text: Column, severity: Column, words: dict[str, str]) -> Column:
    """low, medium or high: by the first of ``words`` in the text, else by severity."""
    by_severity = F.when(F.lower(severity).isin("critical", "high"), "high").when(F.lower(severity) == "medium", "medium").otherwise("low")
    out = by_severity
    for word, effort_ in reversed(words.items()):
        out = F.when(F.lower(text).contains(word), effort_).otherwise(out)
    return out
