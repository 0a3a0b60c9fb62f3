"""Queries on whether findings hold, on what is reported of them, and on orders that reports list them in."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagos import schema
from pelagos.functions import scalars as S
from pelagos.operators import code, dedup, joins, rank, score, verify
from pelagos.plans import views
from pelagos.plans.codes import _HITS
from pelagos.plans.findings import ENHANCED, ORDER
from pelagos.plans.relations import _MATCHED
from pelagos.plans.registry import cases, query

_F8_TYPE = "CASE ord % 4 WHEN 0 THEN 'reentrancy' WHEN 1 THEN 'integer-overflow' WHEN 2 THEN 'timestamp' ELSE type END"
_F8_SWC = "CASE WHEN ord % 5 = 0 THEN 'SWC-107' ELSE '' END"
_F8_TOOLS = "CASE WHEN ord % 3 = 0 THEN 2 ELSE 1 END"
_SIGNS = {n: f"regexp_matches(text, '{p}')" for n, p in verify.CODE_SIGN.items()} | {
    "high_confidence": "coalesce(confidence, 0.5) > 0.8", "low_confidence": "coalesce(confidence, 0.5) < 0.4", "multi_tool": "tools > 1", "single_tool": "tools = 1", "has_swc_id": "swc_id <> ''",
}


def _weight(name: str) -> str:
    own = {t: w[name] for t, w in verify.SIGN_WEIGHT_OF_TYPE.items() if name in w}
    return cases("kind", own, f"{verify.SIGN_WEIGHT[name]}::DOUBLE") if own else f"{verify.SIGN_WEIGHT[name]}::DOUBLE"


_SCORE = " + ".join(f"CASE WHEN {sign} THEN {_weight(name)} ELSE 0 END" for name, sign in ((n, _SIGNS[n]) for n in verify.SIGN_WEIGHT if n in _SIGNS))


@query("f8_false_positive_scores", f"""x AS (SELECT ord, confidence, text, {_F8_TYPE} AS type, {_F8_SWC} AS swc_id, {_F8_TOOLS} AS tools, replace({_F8_TYPE}, '-', '_') AS kind FROM findings JOIN contracts ON doc_id = line + 1),
s AS (SELECT ord, round_even(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.3::DOUBLE + {cases('kind', verify.TYPE_BOOST, '0.0::DOUBLE')} + {_SCORE})), 6) AS fp_score FROM x) SELECT ord, fp_score, fp_score >= 0.5 AS likely_fp FROM s""")
def f8(spark, sf):
    """False-positive scores of findings by the signs in their contracts."""
    f = views.findings(spark, sf).select("ord", "confidence", (F.col("line") + 1).alias("doc_id"), F.expr(_F8_TYPE).alias("type"), F.expr(_F8_SWC).alias("swc_id"), F.expr(_F8_TOOLS).alias("tools"))
    return verify.false_positive_score(verify.signs_at(f, views.contracts(spark, sf))).select("ord", "fp_score", "likely_fp")


@query("f12_worth_checking", f"SELECT ord FROM findings WHERE {ORDER} >= 3")
def f12(spark, sf):
    return verify.worth_checking(views.findings(spark, sf), "high").select("ord")


@query("f13_reliable_findings", "SELECT ord, confidence * 0.8 AS confidence FROM findings WHERE ord % 4 <> 0 AND confidence * 0.8 >= 0.3")
def f13(spark, sf):
    f = views.findings(spark, sf).withColumns({"is_reliable": F.col("ord") % 4 != 0, "adjusted_confidence": F.col("confidence") * 0.8})
    return verify.reliable(f).select("ord", "confidence")


_SWC = "'SWC-' || (100 + ord % 37)"


@query("f20_checklist", "SELECT file, " + ", ".join(f"count(*) FILTER (WHERE {_SWC} = '{swc}') = 0 AS {name}" for name, swc in verify.CHECKLIST.items()) + " FROM findings GROUP BY file")
def f20(spark, sf):
    return verify.checklist(views.findings(spark, sf).select("file", F.expr(_SWC).alias("swc_id")))


@query("p15_cache_hashes", "SELECT f.ord, substr(sha256(concat_ws('|', f.type, f.severity, f.file, substr(f.message, 1, 100))), 1, 16) AS finding_hash FROM findings f")
def p15(spark, sf):
    f = views.findings(spark, sf)
    return f.select("ord", verify.finding_hash(F.col("type"), F.col("severity"), F.col("file"), F.col("message")).alias("finding_hash"))


@query("p15_code_hashes", "SELECT doc_id, substr(sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 32) AS code_hash FROM contracts")
def p15_code(spark, sf):
    return views.contracts(spark, sf).select("doc_id", verify.code_hash(F.col("text")).alias("code_hash"))


_TITLES = "CASE ord % 3 WHEN 0 THEN message WHEN 1 THEN type ELSE 'price oracle of ' || function END"
_WORDS = "[" + ", ".join(f"'{w}'" for w in verify.TITLE_WORDS) + "]"
_SIDES = f"""sides AS (SELECT ord, tool, file, lower({_TITLES}) AS title, CASE WHEN ord % 2 = 0 THEN {_SWC} ELSE '' END AS swc_id FROM findings),
w AS (SELECT *, list_filter({_WORDS}, lambda k: contains(title, k)) AS words FROM sides)"""


def _sides(spark, sf):
    f = views.findings(spark, sf).select("ord", "tool", "file", F.expr(_TITLES).alias("title"), F.expr(f"CASE WHEN ord % 2 = 0 THEN {_SWC} ELSE '' END").alias("swc_id"))
    return f.where("tool = 'slither'"), f.where("tool = 'mythril'")


@query("j6_title_pairs", f"""{_SIDES} SELECT p.file, p.ord AS p, t.ord AS t FROM w p JOIN w t ON p.file = t.file AND p.tool = 'slither' AND t.tool = 'mythril'
WHERE (p.swc_id <> '' AND p.swc_id = t.swc_id) OR contains(t.title, p.title) OR contains(p.title, t.title) OR list_has_any(p.words, t.words)""")
def j6(spark, sf):
    """Predicted and true findings of a file that say the same."""
    return verify.title_pairs(*_sides(spark, sf), ["file"])


@query("j6_title_match_counts", f"""{_SIDES}, pairs_of AS (SELECT p.file AS grp, p.ord AS l, t.ord AS r FROM w p JOIN w t ON p.file = t.file AND p.tool = 'slither' AND t.tool = 'mythril'
WHERE (p.swc_id <> '' AND p.swc_id = t.swc_id) OR contains(t.title, p.title) OR contains(p.title, t.title) OR list_has_any(p.words, t.words)){_MATCHED.replace('walk', 'steps')},
tp AS (SELECT grp AS file, count(*) AS tp FROM steps WHERE ok GROUP BY grp), n AS (SELECT file, count(*) FILTER (WHERE tool = 'slither') AS predicted, count(*) FILTER (WHERE tool = 'mythril') AS truth FROM w WHERE tool IN ('slither', 'mythril') GROUP BY file)
SELECT n.file, coalesce(tp, 0)::BIGINT AS tp, predicted - coalesce(tp, 0)::BIGINT AS fp, truth - coalesce(tp, 0)::BIGINT AS fn FROM n LEFT JOIN tp ON n.file = tp.file""")
def j6_counts(spark, sf):
    """Findings of either side used once, in order."""
    predicted, truth = _sides(spark, sf)
    used = joins.one_to_one(verify.title_pairs(predicted, truth, ["file"]), ["file"], "p", "t")
    return verify.matched_counts(predicted, truth, used, ["file"])


@query("k15_notifications", f"""p AS (SELECT file, type, severity, row_number() OVER (PARTITION BY file ORDER BY {ORDER} DESC, ord) AS place FROM findings),
c AS (SELECT file, count(*) AS total, count(*) FILTER (WHERE severity = 'Critical') AS c, count(*) FILTER (WHERE severity = 'High') AS h, count(*) FILTER (WHERE severity = 'Medium') AS m, count(*) FILTER (WHERE severity = 'Low') AS l, count(*) FILTER (WHERE severity = 'Info') AS i FROM findings GROUP BY file),
t AS (SELECT file, string_agg('"' || type || '"', ',' ORDER BY place) AS top FROM p WHERE place <= 3 GROUP BY file)
SELECT file, '{{"status":"' || CASE WHEN c + h > 0 THEN 'fail' ELSE 'pass' END || '","total_findings":' || total || ',"severity_counts":{{"critical":' || c || ',"high":' || h || ',"medium":' || m || ',"low":' || l || ',"info":' || i || '}},"top_findings":[' || top || ']}}' AS payload FROM c JOIN t USING (file)""")
def k15(spark, sf):
    return verify.notification(views.findings(spark, sf))


@query("a2_aggregator_statistics", f"{ENHANCED} SELECT (SELECT count(*) FROM findings) AS original, count(*) AS deduplicated, count(*) FILTER (WHERE tool_count > 1) AS cross_validated, round_even(avg(confidence), 6) AS mean_confidence, round_even(1 - count(*)::DOUBLE / (SELECT count(*) FROM findings), 6) AS reduction FROM semantic")
def a2(spark, sf):
    f = views.findings(spark, sf)
    return verify.reduction(f, dedup.semantic(f))


@query("x4_session_states", "SELECT user_id, min(ts) AS began, count(*) AS steps, round_even(1 - count(*) FILTER (WHERE event_type = 'error')::DOUBLE / count(*), 6) AS progress, CASE arg_max(event_type, (ts, event_id)) WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'running' END AS state FROM events GROUP BY user_id")
def x4(spark, sf):
    return verify.session_states(views.table(spark, sf, "events"))


_BY_SEVERITY = f"{ORDER} DESC, confidence DESC NULLS LAST, ord"


@query("o4_severity_then_confidence", f"SELECT ord, row_number() OVER (ORDER BY {_BY_SEVERITY})::INT AS place FROM findings ORDER BY place LIMIT 50")
def o4(spark, sf):
    order = [S.lookup(schema.SEVERITY_ORDER, F.lower("severity"), 0).desc(), F.desc_nulls_last("confidence"), F.asc("ord")]
    return rank.first_rows(views.findings(spark, sf), order, 50).select("ord", "place")


@query("o6_top_of_each_tool", f"SELECT tool, ord, rank FROM (SELECT tool, ord, row_number() OVER (PARTITION BY tool ORDER BY {_BY_SEVERITY})::INT AS rank FROM findings) WHERE rank <= 5")
def o6(spark, sf):
    order = [S.lookup(schema.SEVERITY_ORDER, F.lower("severity"), 0).desc(), F.desc_nulls_last("confidence"), F.asc("ord")]
    return rank.top_per(views.findings(spark, sf), ["tool"], order, 5).select("tool", "ord", "rank")


@query("o14_most_frequent_types", "SELECT file, type, n, rank FROM (SELECT file, type, n, row_number() OVER (PARTITION BY file ORDER BY n DESC, type)::INT AS rank FROM (SELECT file, type, count(*) AS n FROM findings GROUP BY file, type)) WHERE rank <= 2")
def o14(spark, sf):
    counted = views.findings(spark, sf).groupBy("file", "type").agg(F.count("*").alias("n"))
    return rank.top_per(counted, ["file"], [F.desc("n"), F.asc("type")], 2)


@query("o15_hits_by_line", f"{_HITS} SELECT doc_id, line_no, rule, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, rule)::INT AS rank FROM hits")
def o15(spark, sf):
    hits = code.detect(views.contracts(spark, sf))
    return rank.top_per(hits, ["doc_id"], [F.asc("line_no"), F.asc("rule")], 1 << 30).select("doc_id", "line_no", "rule", "rank")


@query("o2_dense_priorities", f"{ENHANCED} SELECT ord, dense_rank() OVER (PARTITION BY file ORDER BY {ORDER} DESC)::INT AS priority FROM enhanced")
def o2(spark, sf):
    """Dense places of the findings of a file by severity."""
    from pyspark.sql import Window

    rows = score.enhance(views.findings(spark, sf), ("slither", "aderyn", "mythril"), ("smartllm", "gptscan"))
    order = S.lookup(schema.SEVERITY_ORDER, F.lower("severity"), 0).desc()
    return rows.select("ord", F.dense_rank().over(Window.partitionBy("file").orderBy(order)).alias("priority"))
