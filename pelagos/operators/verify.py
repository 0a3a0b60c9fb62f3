"""Whether findings hold: false-positive scores, checks worth their cost, checklists, hashes for caches, greedy title matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pelagos import schema, session
from pelagos.functions import scalars as S

# What each sign adds to the score of a false positive, and what it adds instead for some types.
SIGN_WEIGHT = {
    "has_reentrancy_guard": 0.35, "has_access_control": 0.1, "follows_cei_pattern": 0.05, "is_solidity_08_plus": 0.1, "uses_safemath": 0.15, "has_require_check": 0.02,
    "has_modifier": 0.02, "is_proxy_contract": 0.1, "is_upgradeable": 0.05, "has_initializer": 0.02, "high_confidence": -0.1, "low_confidence": 0.05, "multi_tool": -0.15,
    "single_tool": 0.02, "has_swc_id": -0.05,
}
SIGN_WEIGHT_OF_TYPE = {
    "reentrancy": {"has_reentrancy_guard": 0.45, "follows_cei_pattern": 0.1},
    "arithmetic": {"is_solidity_08_plus": 0.4, "uses_safemath": 0.35},
    "integer_overflow": {"is_solidity_08_plus": 0.4, "uses_safemath": 0.35},
    "integer_underflow": {"is_solidity_08_plus": 0.4, "uses_safemath": 0.35},
    "access_control": {"has_access_control": 0.15, "has_modifier": 0.1},
}
TYPE_BOOST = {"timestamp": 0.1}
#: Weakness that must be absent for each entry of the checklist.
CHECKLIST = {
    "no_unprotected_withdrawal": "SWC-105", "no_origin_check": "SWC-115", "protected_end": "SWC-106", "no_reentrancy": "SWC-107", "no_overflow": "SWC-101",
    "calls_checked": "SWC-104", "no_denial": "SWC-113", "no_floating_version": "SWC-103", "nothing_deprecated": "SWC-111", "no_weak_randomness": "SWC-120",
}

#: Signs in the code of a contract.
CODE_SIGN = {
    "has_reentrancy_guard": r"(?i)\bnonReentrant\b|\bReentrancyGuard\b", "has_access_control": r"\bonly[A-Z]\w*", "uses_safemath": r"\busing\s+SafeMath\b",
    "is_solidity_08_plus": r"\bpragma\s+solidity\s*[\^>=]*\s*0\.[89]\b", "has_require_check": r"\b(?:require|assert)\s*\(", "is_proxy_contract": r"\bdelegatecall\b|\bProxy\b",
    "is_upgradeable": r"\bUpgradeable\b|\binitializer\b", "has_initializer": r"\bfunction\s+initialize\b",
}


def code_signs(contracts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and a flag per sign of ``CODE_SIGN``: found in the code or not (null code: not)."""
    return contracts.select(key, *[F.coalesce(F.col(text).rlike(p), F.lit(False)).alias(name) for name, p in CODE_SIGN.items()])


def signed(findings: DataFrame, contracts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``code_signs`` of the contracts that a finding names; the others are not searched."""
    named = findings.where(F.col(key).isNotNull()).select(key).distinct()
    return code_signs(contracts.join(session.shuffled(named), key, "left_semi"), key, text)


def signs_at(findings: DataFrame, contracts: DataFrame, key: str = "doc_id", text: str = "text", most: int = 500_000) -> DataFrame:
    """``findings`` with the signs of their contracts, those without a contract left out. Signs of ``most`` contracts at most
    are sent to where the findings are, since a few contracts may have nearly all of these."""
    session.ensure_checkpoint_dir(findings.sparkSession)
    signs = signed(findings, contracts, key, text).checkpoint()
    return findings.join(F.broadcast(signs) if signs.count() <= most else session.shuffled(signs), key)


def false_positive_score(findings: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds ``fp_score`` and ``likely_fp`` to ``findings(type, confidence, tools, swc_id, sign columns...)``.

    0.3 and the type's boost, and for every sign that holds its weight (the type's own, if it has one), clamped to [0, 1];
    signs that ``findings`` has no column for do not hold.
    """
    kind = F.replace(F.lower(F.coalesce("type", F.lit(""))), F.lit("-"), F.lit("_"))
    confidence = F.coalesce("confidence", F.lit(0.5))
    signs = {n: F.col(n) for n in SIGN_WEIGHT if n in findings.columns}
    signs |= {"high_confidence": confidence > 0.8, "low_confidence": confidence < 0.4, "multi_tool": F.col("tools") > 1, "single_tool": F.col("tools") == 1, "has_swc_id": F.coalesce(F.col("swc_id") != "", F.lit(False))}
    score = F.lit(0.3) + S.lookup(TYPE_BOOST, kind, 0.0)
    for name, sign in signs.items():
        own = {t: w[name] for t, w in SIGN_WEIGHT_OF_TYPE.items() if name in w}
        weight = S.lookup(own, kind, SIGN_WEIGHT[name]) if own else F.lit(SIGN_WEIGHT[name])
        score = score + F.when(sign, weight).otherwise(0.0)
    score = F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6)
    return findings.withColumn("fp_score", score).withColumn("likely_fp", F.col("fp_score") >= threshold)


def worth_checking(findings: DataFrame, least: str = "medium") -> DataFrame:
    """Findings of severity ``least`` or worse; unknown severities are the least."""
    rank = S.lookup(schema.SEVERITY_ORDER, F.lower(F.coalesce("severity", F.lit(""))), 0)
    return findings.where(rank >= schema.SEVERITY_ORDER.get(least, 0))


def reliable(validated: DataFrame, least: float = 0.3) -> DataFrame:
    """Findings that were found reliable, with an adjusted confidence of ``least`` or more, which replaces theirs."""
    return validated.where(F.col("is_reliable") & (F.col("adjusted_confidence") >= least)).withColumn("confidence", F.col("adjusted_confidence"))


def checklist(findings: DataFrame, by: str = "file") -> DataFrame:
    """A flag per entry of ``CHECKLIST`` and group: whether no finding has its weakness. One combinable aggregate."""
    return findings.groupBy(by).agg(*[(F.count_if(F.col("swc_id") == swc) == 0).alias(name) for name, swc in CHECKLIST.items()])


def code_hash(code: Column) -> Column:
    """Cache key of source code: half a SHA-256 of its words, one blank between them."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(code, r"\s+", " ")), 256), 1, 32)


def finding_hash(type_: Column, severity: Column, location: Column, description: Column) -> Column:
    """Cache key of a finding: a quarter of a SHA-256 of what it says, the description's first 100 characters."""
    parts = [F.coalesce(c, F.lit("")) for c in (type_, severity, location, F.substring(description, 1, 100))]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


# Words that make titles match.
TITLE_WORDS = (
    "reentrancy", "overflow", "underflow", "access control", "delegatecall", "selfdestruct", "front-run", "frontrun", "oracle", "flash loan", "flash-loan", "signature", "replay", "dos",
    "denial of service", "timestamp", "randomness", "phishing", "permit", "callback", "proxy", "storage", "uninitialized", "precision", "liquidat", "timelock", "admin", "zero address",
    "price", "manipulation", "same-block", "same block",
)


def title_pairs(predicted: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """``(by, p, t)``: predicted findings and true ones of one group that say the same: equal weakness, one title inside the
    other, or a common word of ``TITLE_WORDS``. Groups are documents, so the join is one on equality."""
    words = lambda title: F.array_compact(F.array(*[F.when(title.contains(w), F.lit(w)) for w in TITLE_WORDS]))
    side = lambda df, name: df.select(*by, F.col("ord").alias(name), F.col("swc_id").alias(f"{name}_swc"), F.lower("title").alias(f"{name}_title")).withColumn(f"{name}_words", words(F.col(f"{name}_title")))
    both = side(predicted, "p").join(side(truth, "t"), by)
    titled = (F.col("p_title") != "") & (F.col("t_title") != "")
    same = (F.col("p_swc") != "") & (F.col("p_swc") == F.col("t_swc"))
    near = titled & (F.col("t_title").contains(F.col("p_title")) | F.col("p_title").contains(F.col("t_title")) | F.arrays_overlap("p_words", "t_words"))
    return both.where(F.coalesce(same, F.lit(False)) | F.coalesce(near, F.lit(False))).select(*by, "p", "t")


def matched_counts(predicted: DataFrame, truth: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """True and false positives and misses per group, of pairs that use each finding once."""
    n = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    joined = n(predicted, "predicted").join(n(truth, "truth"), by, "full_outer").join(n(pairs, "tp"), by, "left").na.fill(0)
    return joined.select(*by, "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("truth") - F.col("tp")).alias("fn"))


def notification(findings: DataFrame, by: str = "file", most: int = 3) -> DataFrame:
    """Per group a JSON payload: status (fail with a critical or high finding), counts by severity, the worst findings."""
    rank = S.lookup(schema.SEVERITY_ORDER, F.lower("severity"), 0)
    counts = [F.count_if(F.lower("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")]
    # Only the worst few of each group are ever gathered: their places come from a window that sorts and spills.
    place = F.row_number().over(Window.partitionBy(by).orderBy(rank.desc(), "ord"))
    top = findings.withColumn("place", place).where(F.col("place") <= most).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", "type", "severity"))).alias("top"))
    summed = findings.groupBy(by).agg(F.count("*").alias("total"), *counts).join(top, by)
    status = F.when(F.col("critical") + F.col("high") > 0, "fail").otherwise("pass")
    payload = F.to_json(F.struct(status.alias("status"), F.col("total").alias("total_findings"), F.struct(*["critical", "high", "medium", "low", "info"]).alias("severity_counts"), F.col("top.type").alias("top_findings")))
    return summed.select(by, payload.alias("payload"))


def reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: findings before and after deduplication, the share that went, and how many are of several tools."""
    a = before.agg(F.count("*").alias("original"))
    b = after.agg(F.count("*").alias("deduplicated"), F.count_if(F.col("tool_count") > 1).alias("cross_validated"), F.bround(F.avg("confidence"), 6).alias("mean_confidence"))
    return a.crossJoin(b).select("*", F.bround(1 - F.col("deduplicated") / F.col("original"), 6).alias("reduction"))  # one row each


def session_states(events: DataFrame, by: str = "user_id") -> DataFrame:
    """Life of each session: when it began, how far it is (share of events that are no errors), how it stands."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    out = events.groupBy(by).agg(F.min("ts").alias("began"), F.count("*").alias("steps"), F.count_if(F.col("event_type") == "error").alias("errors"), last.alias("last"))
    state = F.when(F.col("last") == "error", "failed").when(F.col("last") == "purchase", "completed").otherwise("running")
    return out.select(by, "began", "steps", F.bround(1 - F.col("errors") / F.col("steps"), 6).alias("progress"), state.alias("state"))
