"""Evidence combined into confidence, risk and summary figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos import schema
from pelagos.functions import scalars as S

#: Types that one tool alone is not enough for, and the confidence it may reach.
NEEDS_SECOND_TOOL, SINGLE_TOOL_MAX = ("reentrancy", "access-control", "timestamp", "tx-origin", "arithmetic"), 0.60


def enhance(findings: DataFrame, static_tools: tuple[str, ...], model_tools: tuple[str, ...]) -> DataFrame:
    """Deduplicated findings with confidence, calibrated severity and cross-validation marks, unordered.

    A group seen by both a static and a model tool is validated by either side and gains 0.15, to 0.99 at most.
    """
    from pelagos.operators import dedup

    merged = dedup.semantic(findings)
    has = lambda names: F.arrays_overlap("tools", F.array(*map(F.lit, names)))
    both = has(static_tools) & has(model_tools)
    return merged.select(
        "category", "file", "function", "line_bucket", "tool_count", "n_findings",
        F.array_join("tools", ",").alias("tools"),
        F.when(both, F.bround(F.least(F.lit(0.99), F.col("confidence") + 0.15), 3)).otherwise(F.col("confidence")).alias("confidence"),
        S.calibrated_severity(F.col("best.tool"), F.col("best.severity")).alias("severity"),
        both.alias("cross_validated"),
        F.col("best.ord").alias("ord"),
    )


def merge_groups(rows: DataFrame, group: list[str], boost: float = 0.15) -> DataFrame:
    """One row per group: most severe row as the base (first by ``ord``), distinct tools, the best confidence raised by
    ``boost`` for each further tool, the longest message, the first known identifier."""
    rank = S.lookup(schema.SEVERITY_RANK, F.lower("severity"), 5)
    rows = rows.withColumns({
        "pick": F.struct(rank.alias("rank"), (-F.col("ord")).alias("neg")),
        "length": F.struct(F.length("message").alias("n"), (-F.col("ord")).alias("neg")),
    })
    return rows.groupBy(*group).agg(
        F.max_by("severity", "pick").alias("severity"),
        F.max_by("line", "pick").alias("line"),
        F.array_sort(F.collect_set("tool")).alias("tools"),
        S.few_distinct(F.col("tool")).alias("confirmations"),
        F.least(F.lit(1.0), F.max("confidence") + (S.few_distinct(F.col("tool")) - 1) * boost).alias("confidence"),
        F.max_by("message", "length").alias("message"),
        F.count("*").alias("n_findings"),
    )


def calibrate(groups: DataFrame, fp_probability: Column | None = None) -> DataFrame:
    """Adds ``score`` and ``level`` to groups with ``type`` and distinct ``tools``: best prior, 0.05 for each of up to three
    further tools, less the chance of a false positive, capped for one tool on types that need a second."""
    prior = F.array_max(F.transform("tools", lambda t: S.lookup(schema.TOOL_WEIGHT, F.lower(t), 0.5)))
    n = F.greatest(F.size("tools"), F.lit(1))
    score = F.coalesce(prior, F.lit(0.5)) + 0.05 * F.least(n - 1, F.lit(3))
    if fp_probability is not None:
        score = score * (1 - F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fp_probability)), F.lit(0.0)))
    needs = F.lit(False)
    for name in NEEDS_SECOND_TOOL:
        needs = needs | F.lower("type").contains(name)
    score = F.when((n < 2) & needs, F.least(score, F.lit(SINGLE_TOOL_MAX))).otherwise(score)
    out = groups.withColumn("score", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(0.99), score)), 2))
    return out.withColumn("level", S.confidence_level(F.col("score")))


def security_score(findings: DataFrame, by: list[str]) -> DataFrame:
    """100 less the penalties of the severities scaled by confidence (unknown: 1), and the grade, per ``by``."""
    penalty = S.lookup(schema.SEVERITY_PENALTY, F.lower(F.trim("severity")), 5.0)
    weight = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))), F.lit(1.0))
    summed = findings.groupBy(*by).agg(F.count("*").alias("total"), F.sum(penalty * weight).alias("raw"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.bround(100 - F.bround("raw", 6)).cast("int")))
    return summed.select(*by, "total", F.bround(F.bround("raw", 6), 1).alias("penalty"), score.alias("score"), S.grade(score).alias("grade"))


def severity_counts(findings: DataFrame, by: list[str], severities: tuple[str, ...] = ("critical", "high", "medium", "low", "info")) -> DataFrame:
    """A column of counts per severity, one pass."""
    return findings.groupBy(*by).agg(*[F.count_if(F.lower("severity") == s).alias(f"n_{s}") for s in severities], F.count("*").alias("total"))


def overall_risk(findings: DataFrame, by: list[str]) -> DataFrame:
    """Severity weights summed to 100 at most, and whether to deploy."""
    weight = S.lookup(schema.RISK_WEIGHT, F.lower("severity"), 5)
    out = findings.groupBy(*by).agg(
        F.least(F.lit(100), F.sum(weight)).cast("int").alias("risk"),
        F.count_if(F.lower("severity") == "critical").alias("critical"),
        F.count_if(F.lower("severity") == "high").alias("high"),
    )
    verdict = F.when(F.col("critical") > 0, "NO-GO").when(F.col("high") > 0, "CONDITIONAL").otherwise("GO")
    return out.withColumn("recommendation", verdict)


def risk_matrix(findings: DataFrame) -> DataFrame:
    """Counts of all nine cells of impact by likelihood, zeros included: the cells are one array, not a join."""
    low = F.lower("severity")
    cell = F.when(low == "critical", "high_high").when(low == "high", "high_med").when(low == "medium", "med_med").when(low == "low", "low_med").otherwise("low_low")
    names = [f"{i}_{k}" for i in ("high", "med", "low") for k in ("high", "med", "low")]
    counts = findings.select(cell.alias("cell")).agg(*[F.count_if(F.col("cell") == n).alias(n) for n in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("cell"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.cell", "x.n")


def consensus(findings: DataFrame, prior: float = 0.15, keep: float = 0.30, width: int = 10) -> DataFrame:
    """Bayesian consensus per type, file and line bucket: log-odds of the prior and of each tool once, more if the tools
    come from two or three layers; posterior at most 0.98, groups under ``keep`` left out."""
    rows = findings.select("type", "file", S.bucket(F.col("line"), width).alias("bucket"), "tool").distinct()
    weight = S.lookup(schema.TOOL_WEIGHT, F.col("tool"), 0.6)
    grouped = rows.groupBy("type", "file", "bucket").agg(
        F.sum(F.ln(weight / (1 - weight))).alias("evidence"),
        F.count("*").alias("tool_count"),
        S.few_distinct(S.lookup(schema.TOOL_LAYER, F.col("tool"), 0)).alias("layer_count"),
    )
    odds = F.ln(F.lit(prior / (1 - prior))) + F.col("evidence") + F.when(F.col("layer_count") >= 2, 0.5).otherwise(0.0) + F.when(F.col("layer_count") >= 3, 0.3).otherwise(0.0)
    posterior = F.least(1 / (1 + F.exp(-odds)), F.lit(0.98))
    return grouped.select("type", "file", "bucket", "tool_count", "layer_count", F.bround(posterior, 4).alias("posterior")).where(F.col("posterior") >= keep)


def ewma(samples: DataFrame, key: str, value: str, order: str, alpha: float = 0.3, start: float = 0.5) -> DataFrame:
    """Exponentially weighted mean in order of ``order``: the newest value weighs alpha, the k-th before it
    alpha * (1 - alpha)^k, and the start what is left. One sum of weighted values per key, so that no key is gathered."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) - 1
    weighed = samples.select(key, F.col(value).cast("double").alias("v"), back.alias("back"))
    keep = F.lit(1.0 - alpha)
    mean = F.sum(F.col("v") * alpha * F.pow(keep, F.col("back"))) + start * F.pow(keep, F.count("*"))
    return weighed.groupBy(key).agg(mean.alias("ewma"))


def clamped_walk(samples: DataFrame, key: str, up: str, order: str, step_up: float = 0.02, step_down: float = 0.05, low: float = -0.3, high: float = 0.2) -> DataFrame:
    """Running adjustment that is clamped at every step, in order; unlike a clamped sum, early steps can be lost.

    A stretch of steps maps x to min(h, max(l, x + s)), and such maps compose to such a map, so stretches of 4096 rows
    are folded on their own and the few maps of a key are composed after.
    """
    placed = samples.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    move = F.when(F.col(up), step_up).otherwise(-step_down)
    stretch = placed.groupBy(key, F.floor((F.col("at") - 1) / 4096).alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", move.alias("m")))), lambda x: x["m"]).alias("moves")
    )
    clamp = lambda x: F.least(F.lit(high), F.greatest(F.lit(low), x))
    ends = lambda x0: F.aggregate("moves", F.lit(x0), lambda x, m: F.bround(clamp(x + m), 10))
    whole = F.aggregate("moves", F.lit(0.0), lambda x, m: F.bround(x + m, 10))
    maps = stretch.select(key, "part", ends(low).alias("l"), ends(high).alias("h"), whole.alias("s"))
    chain = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("part", "l", "h", "s"))).alias("maps"))
    return chain.select(key, F.aggregate("maps", F.lit(0.0), lambda x, m: F.bround(F.least(m["h"], F.greatest(m["l"], x + m["s"])), 10)).alias("adjustment"))


def weighted_confidence(groups: DataFrame) -> DataFrame:
    """Adds ``weighted`` to ``groups(confidence, tools array)``: the confidence, 0.1 more if two reliable tools report (weight of
    0.8 or more), 0.05 more for one of them beside any other, 0.99 at most; no tools: the confidence as it is, else 0.5."""
    reliable = F.size(F.filter("tools", lambda t: S.lookup(schema.TOOL_WEIGHT, F.lower(t), 0.5) >= 0.8))
    boost = F.when(reliable >= 2, 0.1).when((reliable == 1) & (F.size("tools") >= 2), 0.05).otherwise(0.0)
    raised = F.least(F.lit(0.99), F.coalesce("confidence", F.lit(0.7)) + boost)
    return groups.withColumn("weighted", F.bround(F.when(F.size("tools") > 0, raised).otherwise(F.coalesce("confidence", F.lit(0.5))), 6))


def counts_by(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(dimension, value, n)``: how often each value of each column occurs, in one pass and one shuffle of partial counts."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def merged_maps(base: Column, over: Column) -> Column:
    """Two maps of maps as one; where both have an entry, that of ``over`` counts."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(base, F.create_map().cast("map<string,map<string,string>>")), F.coalesce(over, F.create_map().cast("map<string,map<string,string>>")),
        lambda k, a, b: F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda n, x, y: F.coalesce(y, x)))


#: Tools that read code by rules, tools that ask a model, what agreement of both adds.
STATIC_TOOLS, MODEL_TOOLS, AGREEMENT = ("slither", "aderyn", "mythril"), ("smartllm", "gptscan"), 0.15


def tagged(merged: DataFrame) -> DataFrame:
    """Adds ``tag`` (cross, model, static) by the kinds of tools in ``tools``, and ``confidence``: ``c``, more where both agree."""
    has = lambda names: F.arrays_overlap("tools", F.array(*map(F.lit, names)))
    both = has(STATIC_TOOLS) & has(MODEL_TOOLS)
    tag = F.when(both, "cross").when(has(MODEL_TOOLS), "model").otherwise("static")
    return merged.withColumn("tag", tag).withColumn("confidence", F.least(F.lit(1.0), F.col("c") + F.when(both, AGREEMENT).otherwise(0.0)))
