"""Queries of correlation, severity, remediation, per-category evaluation, policies and streams of sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagos import schema
from pelagos.functions import safety
from pelagos.functions import scalars as S
from pelagos.operators import correlate, joins, rank, severity
from pelagos.plans import views
from pelagos.plans.findings import CATEGORY, ORDER
from pelagos.plans.registry import cases, query
from pelagos.streaming import events as streams


@query("j2_correlation_methods", f"""b AS (SELECT ord, file, function, line, {CATEGORY} AS category FROM findings),
near AS (SELECT a.ord AS a, c.ord AS b, CASE WHEN a.category = c.category THEN 'exact' WHEN a.function = c.function AND a.function <> '' THEN 'contextual' END AS method FROM b a JOIN b c ON a.file = c.file AND a.ord < c.ord AND abs(a.line - c.line) <= 1),
far AS (SELECT m.a, b.ord AS b, 'semantic' AS method FROM b JOIN (SELECT file, function, category, min(ord) AS a FROM b WHERE function <> '' GROUP BY ALL) m USING (file, function, category) WHERE b.ord <> m.a),
u AS (SELECT * FROM near WHERE method IS NOT NULL UNION ALL SELECT * FROM far)
SELECT a, b, arg_min(method, CASE method WHEN 'exact' THEN 0 WHEN 'semantic' THEN 1 ELSE 2 END) AS method FROM u GROUP BY a, b""")
def j2(spark, sf):
    return correlate.methods(views.findings(spark, sf), 1)


@query("a3_correlated_groups")
def a3(spark, sf):
    return correlate.correlated(views.findings(spark, sf), 1)


@query("a5_correlation_statistics")
def a5(spark, sf):
    return correlate.statistics(correlate.correlated(views.findings(spark, sf), 1))


_BASE = cases("category", severity.BASE, "0.4::DOUBLE")


@query("p24_severity_prediction", f"s AS (SELECT ord, round_even(least(1.0::DOUBLE, greatest(0.1::DOUBLE, {_BASE} + (CASE WHEN value > 300 THEN 0.15::DOUBLE ELSE 0.0 END) + (CASE WHEN function = 'f1' THEN 0.05::DOUBLE ELSE 0.0 END))), 6) AS x FROM (SELECT *, {CATEGORY} AS category FROM findings)) SELECT ord, x AS severity_score, CASE WHEN x >= 0.85 THEN 'critical' WHEN x >= 0.65 THEN 'high' WHEN x >= 0.4 THEN 'medium' WHEN x >= 0.2 THEN 'low' ELSE 'info' END AS predicted FROM s")
def p24(spark, sf):
    f = views.findings(spark, sf)
    return severity.predict(f, F.when(F.col("value") > 300, 2_000_000).otherwise(0), F.col("function") == "f1").select("ord", "severity_score", "predicted")


_EFFORT = "CASE WHEN category IN ('unchecked-call', 'time-manipulation') THEN 'low' WHEN category = 'reentrancy' THEN 'medium' WHEN category = 'access-control' THEN 'trivial' ELSE 'high' END"
_PLAN = f"""n AS (SELECT ord, file, severity, {CATEGORY} AS category FROM findings), e AS (SELECT *, {_EFFORT} AS effort, count(*) OVER (PARTITION BY file, category) - 1 AS more FROM n),
p AS (SELECT ord, category, effort, {cases('effort', severity.HOURS, '16')} AS hours, round_even({cases('lower(severity)', {'critical': 10.0, 'high': 7.0, 'medium': 4.0, 'low': 2.0, 'info': 1.0}, '1.0::DOUBLE')} * (1 + 0.1::DOUBLE * least(more, 5)) * {cases('effort', severity.EFFORT_FACTOR, '1.0::DOUBLE')}, 6) AS priority FROM e)"""


@query("p23_remediation_plan", _PLAN + " SELECT ord, category, effort, hours, priority, hours <= 4 AS quick_win FROM p")
def p23(spark, sf):
    return severity.plan(views.findings(spark, sf)).select("ord", "category", "effort", "hours", "priority", "quick_win")


@query("o12_remediation_order", _PLAN + " SELECT ord, priority, row_number() OVER (ORDER BY priority DESC, ord)::INT AS place FROM p ORDER BY place LIMIT 20")
def o12(spark, sf):
    from pyspark.sql import Window

    top = severity.plan(views.findings(spark, sf)).select("ord", "priority").orderBy(F.desc("priority"), "ord").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("priority"), "ord")))  # 20 rows


@query("a38_effort_hours", _PLAN + " SELECT effort, count(*) AS n, sum(hours)::BIGINT AS hours FROM p GROUP BY effort")
def a38(spark, sf):
    return severity.plan(views.findings(spark, sf)).groupBy("effort").agg(F.count("*").alias("n"), F.sum("hours").alias("hours"))


@query("a16_per_category_evaluation", f"g AS (SELECT {CATEGORY} AS category, ord % 2 = 0 AS d, ord % 3 = 0 AS t FROM findings), c AS (SELECT category, count(*) FILTER (WHERE d AND t) AS tp, count(*) FILTER (WHERE d AND NOT t) AS fp, count(*) FILTER (WHERE NOT d AND t) AS fn FROM g GROUP BY GROUPING SETS ((category), ())) SELECT coalesce(category, 'ALL') AS category, tp, fp, fn, round_even(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round_even(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall FROM c")
def a16(spark, sf):
    f = views.findings(spark, sf).select(S.category(F.col("type")).alias("category"), (F.col("ord") % 2 == 0).alias("d"), (F.col("ord") % 3 == 0).alias("t"))
    c = f.groupingSets([["category"], []], "category").agg(F.count_if(F.col("d") & F.col("t")).alias("tp"), F.count_if(F.col("d") & ~F.col("t")).alias("fp"), F.count_if(~F.col("d") & F.col("t")).alias("fn"))
    rate = lambda other: F.bround(S.ratio(F.col("tp"), F.col("tp") + F.col(other)), 6)
    return c.select(F.coalesce("category", F.lit("ALL")).alias("category"), "tp", "fp", "fn", rate("fp").alias("precision"), rate("fn").alias("recall"))


@query("a29_policy_scorecards", "ctl AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{x}')" for c, xs in schema.CONTROLS.items() for x in xs) + f") t(category, control)), n AS (SELECT {CATEGORY} AS category, {ORDER} AS rk, file FROM findings) SELECT file, control, count(*) AS findings, count(*) FILTER (WHERE rk >= 3) AS severe, CASE WHEN count(*) FILTER (WHERE rk >= 3) > 0 THEN 'fail' ELSE 'review' END AS status FROM n JOIN ctl USING (category) GROUP BY file, control")
def a29(spark, sf):
    controls = spark.createDataFrame([(c, x) for c, xs in schema.CONTROLS.items() for x in xs], "category string, control string")
    n = views.findings(spark, sf).select(S.category(F.col("type")).alias("category"), S.lookup(schema.SEVERITY_ORDER, F.lower("severity"), 0).alias("rk"), "file")
    c = n.groupBy("file", "category").agg(F.count("*").alias("k"), F.count_if(F.col("rk") >= 3).alias("s")).join(F.broadcast(controls), "category")
    out = c.groupBy("file", "control").agg(F.sum("k").alias("findings"), F.sum("s").alias("severe"))
    return out.withColumn("status", F.when(F.col("severe") > 0, "fail").otherwise("review"))


@query("a45_type_coverage", "SELECT tool, count(DISTINCT type) AS types, round_even(count(DISTINCT type) / 37.0::DOUBLE, 6) AS coverage FROM findings WHERE value > 100 GROUP BY tool")
def a45(spark, sf):
    g = views.findings(spark, sf).where("value > 100").groupBy("tool").agg(S.few_distinct(F.col("type")).alias("types"))
    return g.withColumn("coverage", F.bround(F.col("types") / 37.0, 6))


@query("j21_acceptance_order", "p AS (SELECT * FROM (VALUES ('slither', 0.7::DOUBLE), ('mythril', 0.9::DOUBLE), ('gptscan', 0.4::DOUBLE)) t(tool, p)), r AS (SELECT f.file, f.ord, row_number() OVER (PARTITION BY f.file ORDER BY coalesce(p.p, -1) DESC, f.ord)::INT AS place FROM findings f LEFT JOIN p USING (tool)) SELECT file, ord, place FROM r WHERE place <= 5")
def j21(spark, sf):
    known = spark.createDataFrame([("slither", 0.7), ("mythril", 0.9), ("gptscan", 0.4)], "tool string, p double")
    f = views.findings(spark, sf).select("file", "ord", "tool").join(F.broadcast(known), "tool", "left")
    return rank.top_per(f, ["file"], [F.coalesce("p", F.lit(-1.0)).desc(), F.col("ord").asc()], 5, "place").select("file", "ord", "place")


@query("j14_static_validation", "m AS (SELECT ord, file, type, line, coalesce(confidence, 0.7) AS c FROM findings WHERE tool = 'smartllm'), v AS (SELECT m.ord, m.c, count(DISTINCT f.tool) FILTER (WHERE f.type = m.type) AS typed, count(f.ord) AS near FROM m LEFT JOIN findings f ON f.tool IN ('slither', 'aderyn') AND f.file = m.file AND abs(f.line - m.line) <= 5 GROUP BY m.ord, m.c) SELECT ord, typed, round_even(greatest(0.0::DOUBLE, least(1.0::DOUBLE, c + CASE WHEN typed > 0 THEN 0.25::DOUBLE WHEN near > 0 THEN 0.15::DOUBLE ELSE -0.2::DOUBLE END)), 6) AS confidence FROM v")
def j14(spark, sf):
    """Model findings raised by static ones of their type nearby, less by any nearby, lowered without."""
    f = views.findings(spark, sf).select("ord", "tool", "file", "type", "line", "confidence")
    model, static = f.where("tool = 'smartllm'"), f.where(F.col("tool").isin("slither", "aderyn"))
    near = joins.band_join(model, static, ["file"], 5, "left")
    v = near.groupBy("ord").agg(F.first(F.coalesce("confidence", F.lit(0.7))).alias("c"), S.few_distinct(F.when(F.col("r_type") == F.col("type"), F.col("r_tool"))).alias("typed"), F.count("r_ord").alias("near"))
    change = F.when(F.col("typed") > 0, 0.25).when(F.col("near") > 0, 0.15).otherwise(-0.2)
    return v.select("ord", "typed", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c") + change)), 6).alias("confidence"))


@query("f17_metadata_filter", f"SELECT ord, file FROM findings WHERE {CATEGORY} = 'reentrancy' AND severity IN ('Critical', 'High')")
def f17(spark, sf):
    f = views.findings(spark, sf)
    return f.where((S.category(F.col("type")) == "reentrancy") & F.col("severity").isin("Critical", "High")).select("ord", "file")


@query("d12_ledger", "SELECT substr(sha1(type || chr(0) || file || chr(0) || function), 1, 16) AS id, min(ord) AS first_ord, max(ord) AS last_ord, count(*) AS evidence FROM findings GROUP BY 1")
def d12(spark, sf):
    key = F.substring(F.sha1(F.concat_ws("\x00", "type", "file", "function")), 1, 16)
    return views.findings(spark, sf).groupBy(key.alias("id")).agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.count("*").alias("evidence"))


@query("d11_query_dedup", "SELECT min(item_id) AS item_id, substr(text, 1, 200) AS q, count(*) AS n FROM benchmark GROUP BY 2")
def d11(spark, sf):
    return views.table(spark, sf, "benchmark").groupBy(F.substring("text", 1, 200).alias("q")).agg(F.min("item_id").alias("item_id"), F.count("*").alias("n"))


@query("a39_verdict_precedence", "SELECT file, CASE WHEN bool_or(severity = 'Critical') THEN 'violated' WHEN bool_or(severity = 'High') THEN 'unknown' WHEN bool_and(severity IN ('Low', 'Info')) THEN 'proved' ELSE 'partial' END AS verdict FROM findings GROUP BY file")
def a39(spark, sf):
    s = F.col("severity")
    verdict = F.when(F.bool_or(s == "Critical"), "violated").when(F.bool_or(s == "High"), "unknown").when(F.bool_and(s.isin("Low", "Info")), "proved").otherwise("partial")
    return views.findings(spark, sf).groupBy("file").agg(verdict.alias("verdict"))


@query("u6_uncovered_controls", "ctl AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{x}')" for c, xs in schema.CONTROLS.items() for x in xs) + f") t(category, control)) SELECT DISTINCT control FROM ctl WHERE control NOT IN (SELECT control FROM ctl WHERE category IN (SELECT DISTINCT {CATEGORY} FROM findings))")
def u6(spark, sf):
    controls = spark.createDataFrame([(c, x) for c, xs in schema.CONTROLS.items() for x in xs], "category string, control string")
    seen = views.findings(spark, sf).select(S.category(F.col("type")).alias("category")).distinct()
    return controls.select("control").distinct().join(controls.join(seen, "category", "left_semi").select("control"), "control", "left_anti")


@query("u4_new_categories", f"SELECT DISTINCT file, line, {CATEGORY} AS category FROM findings WHERE ts >= TIMESTAMP '2024-01-15' EXCEPT SELECT DISTINCT file, line, {CATEGORY} FROM findings WHERE ts < TIMESTAMP '2024-01-15'")
def u4(spark, sf):
    f = views.findings(spark, sf).select("file", "line", S.category(F.col("type")).alias("category"), (F.col("ts") >= F.lit("2024-01-15").cast("timestamp")).alias("late"))
    return f.groupBy("file", "line", "category").agg(F.bool_and("late").alias("fresh")).where("fresh").select("file", "line", "category")


@query("x7_progress_counters", "SELECT user_id AS audit_id, round_even(sum(value), 6) AS findings, count(*) FILTER (WHERE event_type = 'purchase') AS tools_done, arg_max(event_type, event_id) AS last_event FROM events GROUP BY 1")
def x7(spark, sf):
    e = views.table(spark, sf, "events")
    name = F.when(F.col("event_type") == "purchase", "tool_completed").otherwise(F.col("event_type"))
    out = streams.progress(e.select(F.col("user_id").alias("audit_id"), (F.col("value") * 100).cast("long").alias("found"), name.alias("event"), F.col("event_id").alias("seq")))
    last = F.when(F.col("last_event") == "tool_completed", "purchase").otherwise(F.col("last_event"))
    total = e.groupBy(F.col("user_id").alias("audit_id")).agg(F.sum("value").alias("findings"))
    return out.drop("findings").join(total, "audit_id").select("audit_id", F.bround("findings", 6).alias("findings"), "tools_done", last.alias("last_event"))


@query("x12_retraining_due", "SELECT event_type, count(*) AS queued, count(*) >= 2000 AS due FROM events GROUP BY 1")
def x12(spark, sf):
    return streams.retraining_due(views.table(spark, sf, "events"), "event_type", 2000)


@query("p29_injection_signs", "SELECT role, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '(?i)system prompt|ignore (?:all |any )?(?:previous|prior|above) instructions|disregard (?:the|your) (?:rules|instructions)|you are now (?:a|an|in)\\b|</?(?:system|assistant|user)>')) AS suspicious FROM conversations GROUP BY role")
def p29(spark, sf):
    c = views.table(spark, sf, "conversations").select("role", F.size(safety.injection_signs(F.col("text"))).alias("signs"))
    return c.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("signs") > 0).alias("suspicious"))
