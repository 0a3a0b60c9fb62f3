"""Queries of joins, evaluation, text, vectors, graphs, storage and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagos import schema
from pelagos.functions import scalars as S
from pelagos.operators import evaluate, graph, joins, rank, storage, text, vectors
from pelagos.plans import views
from pelagos.plans.findings import CATEGORY, FINGERPRINT, WEIGHT
from pelagos.plans.registry import query
from pelagos.sinks import writers
from pelagos.streaming import events as streams


def _with_print(f):
    return f.withColumn("fingerprint", S.fingerprint(F.col("type"), F.col("file"), F.col("function"), F.col("message")))


# ---- joins ----------------------------------------------------------------------------------------


@query("j1_band_join", "SELECT a.ord AS a, b.ord AS b FROM findings a JOIN findings b ON a.file = b.file AND a.type = b.type AND a.ord < b.ord AND abs(a.line - b.line) <= 1")
def j1(spark, sf):
    f = views.findings(spark, sf).select("ord", "file", "type", "line")
    return joins.band_join(f, f, ["file", "type"], 1).where("ord < r_ord").select(F.col("ord").alias("a"), F.col("r_ord").alias("b"))


@query("j7_baseline_diff", f"cur AS (SELECT DISTINCT {FINGERPRINT} AS fingerprint FROM findings), base AS (SELECT DISTINCT {FINGERPRINT} AS fingerprint FROM (SELECT type, file, function, type || ' in ' || function || '() (line ' || line || ')' AS message FROM baseline_run WHERE ord % 4 <> 0 UNION ALL SELECT type, 'old/' || file, function, message FROM baseline_run WHERE ord % 50 = 0)) SELECT coalesce(cur.fingerprint, base.fingerprint) AS fingerprint, CASE WHEN base.fingerprint IS NULL THEN 'new' WHEN cur.fingerprint IS NULL THEN 'fixed' ELSE 'known' END AS state FROM cur FULL JOIN base ON cur.fingerprint = base.fingerprint")
def j7(spark, sf):
    """New, known and fixed findings against an earlier run whose lines have moved; fingerprints ignore lines."""
    b = views.baseline(spark, sf)
    moved = b.where("ord % 4 <> 0").withColumn("message", F.concat("type", F.lit(" in "), "function", F.lit("() (line "), "line", F.lit(")")))
    gone = b.where("ord % 50 = 0").withColumn("file", F.concat(F.lit("old/"), "file"))
    return joins.diff(_with_print(views.findings(spark, sf)), _with_print(moved.unionByName(gone)))


@query("j8_tolerance_anti_join", "SELECT ord FROM findings a WHERE tool = 'gptscan' AND NOT EXISTS (SELECT 1 FROM findings b WHERE b.tool = 'slither' AND a.file = b.file AND a.type = b.type AND abs(a.line - b.line) <= 5)")
def j8(spark, sf):
    f = views.findings(spark, sf).select("ord", "tool", "file", "type", "line")
    return joins.band_join(f.where("tool = 'gptscan'"), f.where("tool = 'slither'"), ["file", "type"], 5, "left_anti").select("ord")


_MATCHED = """, placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY l, r) AS k FROM pairs_of),
walk(grp, k, l, r, used_l, used_r, ok) AS (SELECT grp, k, l, r, [l], [r], true FROM placed WHERE k = 1
 UNION ALL SELECT grp, k, l, r, CASE WHEN ok THEN list_append(used_l, l) ELSE used_l END, CASE WHEN ok THEN list_append(used_r, r) ELSE used_r END, ok FROM (
  SELECT p.grp, p.k, p.l, p.r, w.used_l, w.used_r, NOT list_contains(w.used_l, p.l) AND NOT list_contains(w.used_r, p.r) AS ok FROM walk w JOIN placed p ON w.grp = p.grp AND p.k = w.k + 1))"""


@query("j3_one_to_one_match", f"pairs_of AS (SELECT {{'file': s.file, 'type': s.type}} AS grp, s.ord AS l, m.ord AS r FROM findings s JOIN findings m ON s.file = m.file AND s.type = m.type AND s.tool = 'slither' AND m.tool = 'mythril' AND abs(s.line - m.line) <= 5){_MATCHED} SELECT grp.file AS file, grp.type AS type, l AS ord, r AS r_ord FROM walk WHERE ok")
def j3(spark, sf):
    """Greedy one-to-one match of one tool's findings with another's within five lines, file by file."""
    f = views.findings(spark, sf).select("ord", "tool", "file", "type", "line")
    pairs = joins.band_join(f.where("tool = 'slither'"), f.where("tool = 'mythril'"), ["file", "type"], 5).select("file", "type", "ord", "r_ord")
    return joins.one_to_one(pairs, ["file", "type"], "ord", "r_ord")


@query("j5_interval_join", "s AS (SELECT file, line - 2 AS lo, line + 3 AS hi, ord AS bug FROM findings WHERE tool = 'mythril' AND severity = 'High') SELECT f.ord, s.bug FROM findings f JOIN s ON f.file = s.file AND f.line BETWEEN s.lo AND s.hi WHERE f.tool = 'slither'")
def j5(spark, sf):
    f = views.findings(spark, sf)
    spans = f.where("tool = 'mythril' and severity = 'High'").select("file", (F.col("line") - 2).alias("lo"), (F.col("line") + 3).alias("hi"), F.col("ord").alias("bug"))
    return joins.interval_join(f.where("tool = 'slither'").select("ord", "file", "line"), spans, "file", "line", "lo", "hi").select("ord", "bug")


@query("j9_similar_sets", "t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS s FROM documents), k AS (SELECT doc_id, s, len(s) AS n FROM t), p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS both_n, len(list_intersect(a.s, b.s)) AS shared FROM k a JOIN k b ON a.doc_id < b.doc_id AND a.n >= 0.9 * b.n AND b.n >= 0.9 * a.n) SELECT a, b, round_even(shared::DOUBLE / (both_n - shared), 6) AS similarity FROM p WHERE shared::DOUBLE / nullif(both_n - shared, 0) >= 0.9")
def j9(spark, sf):
    """All documents as sets of words, joined by Jaccard similarity of 0.9 or more; without a word they are like nothing."""
    d = views.table(spark, sf, "documents").select("doc_id", F.array_distinct(text.words()).alias("s"))
    return joins.similar_sets(d, "doc_id", "s", 0.9).withColumn("similarity", F.bround("similarity", 6))


@query("j12_lookup_joins", f"SELECT ord, {WEIGHT} AS weight, c.category, controls FROM (SELECT ord, tool, {CATEGORY} AS category FROM findings) c LEFT JOIN (SELECT category, count(*) AS controls FROM (VALUES " + ", ".join(f"('{c}', '{x}')" for c, xs in schema.CONTROLS.items() for x in xs) + ") t(category, control) GROUP BY 1) d ON c.category = d.category")
def j12(spark, sf):
    dim = spark.createDataFrame([(c, len(xs)) for c, xs in schema.CONTROLS.items()], "category string, controls long")
    f = views.findings(spark, sf).select("ord", S.lookup(schema.TOOL_WEIGHT, F.col("tool"), 0.5).alias("weight"), S.category(F.col("type")).alias("category"))
    return f.join(F.broadcast(dim), "category", "left").select("ord", "weight", "category", "controls")


@query("j13_cross_validation", "SELECT ord, EXISTS (SELECT 1 FROM findings s WHERE s.tool IN ('slither', 'aderyn') AND s.file = f.file AND s.type = f.type) AS type_match, EXISTS (SELECT 1 FROM findings s WHERE s.tool IN ('slither', 'aderyn') AND s.file = f.file AND abs(s.line - f.line) <= 5) AS place_match FROM findings f WHERE tool = 'smartllm'")
def j13(spark, sf):
    """Model findings with marks of whether a static tool confirms their type, or their place."""
    f = views.findings(spark, sf).select("ord", "tool", "file", "type", "line")
    static = f.where(F.col("tool").isin("slither", "aderyn"))
    model = f.where("tool = 'smartllm'")
    types = static.select("file", "type").distinct().withColumn("t", F.lit(True))
    places = joins.band_join(model, static.select("file", "line").distinct(), ["file"], 5, "left_semi").select("ord").withColumn("p", F.lit(True))
    out = model.join(types, ["file", "type"], "left").join(places, "ord", "left")
    return out.select("ord", F.coalesce("t", F.lit(False)).alias("type_match"), F.coalesce("p", F.lit(False)).alias("place_match"))


@query("j15_first_within", "SELECT f.ord, (SELECT min(p.ord) FROM findings p WHERE p.tool = 'aderyn' AND p.file = f.file AND abs(p.line - f.line) <= 10) AS first_ord FROM findings f WHERE f.tool = 'slither' AND EXISTS (SELECT 1 FROM findings p WHERE p.tool = 'aderyn' AND p.file = f.file AND abs(p.line - f.line) <= 10)")
def j15(spark, sf):
    f = views.findings(spark, sf).select("ord", "tool", "file", "line")
    out = joins.nearest(f.where("tool = 'slither'"), f.where("tool = 'aderyn'"), ["file"], 10, F.col("r_ord"))
    return out.select("ord", F.col("r_ord").alias("first_ord"))


@query("j17_same_place_tools", "SELECT file, line, count(DISTINCT tool) AS tools FROM findings GROUP BY file, line HAVING count(DISTINCT tool) > 1")
def j17(spark, sf):
    return views.findings(spark, sf).groupBy("file", "line").agg(S.few_distinct(F.col("tool")).alias("tools")).where("tools > 1")


@query("j18_paired_join", "a AS (SELECT file, max(value) AS v FROM findings WHERE tool = 'slither' GROUP BY file), b AS (SELECT file, max(value) AS v FROM findings WHERE tool = 'mythril' GROUP BY file) SELECT a.file, a.v AS on_value, b.v AS off_value FROM a JOIN b ON a.file = b.file")
def j18(spark, sf):
    f = views.findings(spark, sf)
    best = lambda tool, name: f.where(F.col("tool") == tool).groupBy("file").agg(F.max("value").alias(name))
    return best("slither", "on_value").join(best("mythril", "off_value"), "file")


@query("j19_run_deltas", "a AS (SELECT type, file, count(*) AS n FROM findings WHERE ord % 2 = 0 GROUP BY ALL), b AS (SELECT type, file, count(*) AS n FROM findings WHERE ord % 3 = 0 GROUP BY ALL) SELECT coalesce(a.type, b.type) AS type, coalesce(a.file, b.file) AS file, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM a FULL JOIN b ON a.type = b.type AND a.file = b.file")
def j19(spark, sf):
    f = views.findings(spark, sf)
    count = lambda rows, name: rows.groupBy("type", "file").agg(F.count("*").alias(name))
    both = count(f.where("ord % 2 = 0"), "a").join(count(f.where("ord % 3 = 0"), "b"), ["type", "file"], "full_outer")
    return both.select("type", "file", (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("delta"))


_CHAIN_ROWS = [(n, c) for n, cs in schema.CHAINS.items() for c in cs]


@query("j20_exploit_chains", f"need AS (SELECT * FROM (VALUES {', '.join(map(str, _CHAIN_ROWS))}) t(chain, category)), have AS (SELECT DISTINCT file, line // 10 AS part, {CATEGORY} AS category FROM findings), met AS (SELECT h.file, h.part, n.chain, count(*) AS k FROM have h JOIN need n USING (category) GROUP BY ALL) SELECT file, part, chain FROM met JOIN (SELECT chain, count(*) AS k FROM need GROUP BY chain) a USING (chain, k)")
def j20(spark, sf):
    need = spark.createDataFrame(_CHAIN_ROWS, "chain string, category string")
    have = views.findings(spark, sf).select("file", F.floor(F.col("line") / 10).cast("int").alias("part"), S.category(F.col("type")).alias("category"))
    return joins.contains_all(have, need, ["file", "part"], "category", "chain")


@query("j22_inverted_index", "i AS (SELECT p_partkey AS doc, 'type' AS kind, p_type AS tag, 0.5::DOUBLE AS w FROM part UNION ALL SELECT p_partkey, 'brand', p_brand, 0.8::DOUBLE FROM part UNION ALL SELECT p_partkey, 'name', unnest(string_split(p_name, ' ')), 0.3::DOUBLE FROM part), u AS (SELECT DISTINCT * FROM i), q AS (SELECT doc AS query, kind, tag, w FROM u WHERE doc % 100 = 0) SELECT q.query, u.doc, round_even(sum(q.w), 6) AS score FROM q JOIN u ON q.kind = u.kind AND q.tag = u.tag WHERE q.kind <> 'type' GROUP BY ALL HAVING sum(q.w) >= 0.8")
def j22(spark, sf):
    """Parts that share brand or name words with the stated query parts (every hundredth), weights summed."""
    p = views.table(spark, sf, "part")
    tags = F.concat(F.array(F.struct(F.lit("brand").alias("kind"), F.col("p_brand").alias("tag"))), F.transform(F.split("p_name", " "), lambda w: F.struct(F.lit("name").alias("kind"), w.alias("tag"))))
    index = p.select(F.col("p_partkey").alias("doc"), F.explode(tags).alias("t")).select("doc", "t.kind", "t.tag")
    out = joins.weighted_lookup(index.where("doc % 100 = 0").withColumnRenamed("doc", "query"), index, "tag", {"brand": 0.8, "name": 0.3}, "query", "doc", 0.8)
    return out.withColumn("score", F.bround("score", 6))


# ---- evaluation and statistics --------------------------------------------------------------------


@query("a14_confusion_matrix", "t AS (SELECT l.quality = 1 AS y, d.n_chars > 800 AS p, d.lang FROM labels l JOIN documents d USING (doc_id)), c AS (SELECT lang, count(*) FILTER (WHERE p AND y) AS tp, count(*) FILTER (WHERE p AND NOT y) AS fp, count(*) FILTER (WHERE NOT p AND y) AS fn, count(*) FILTER (WHERE NOT p AND NOT y) AS tn FROM t GROUP BY lang), r AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS pr, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS re FROM c) SELECT lang, tp, fp, fn, tn, round_even(pr, 6) AS precision, round_even(re, 6) AS recall, round_even(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, round_even((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy FROM r")
def a14(spark, sf):
    rows = views.table(spark, sf, "labels").join(views.table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return evaluate.confusion(rows, F.col("n_chars") > 800, F.col("quality") == 1, ["lang"])


@query("a15_ranking_metrics", "r AS (SELECT user_id AS q, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rk, (event_type = 'error')::INT AS rel FROM events), i AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rel DESC) AS ir, sum(rel) OVER (PARTITION BY q ORDER BY rk) AS hits FROM r), g AS (SELECT q, coalesce(1.0::DOUBLE / min(rk) FILTER (WHERE rel > 0), 0) AS rr, sum(rel / log2(rk + 1)) AS dcg, sum(rel / log2(ir + 1)) AS idcg, sum(CASE WHEN rel > 0 THEN hits::DOUBLE / rk ELSE 0 END) AS ps, count(*) FILTER (WHERE rel > 0) AS n FROM i GROUP BY q) SELECT q, round_even(rr, 6) AS rr, round_even(dcg, 6) AS dcg, round_even(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg, round_even(coalesce(ps / nullif(n, 0), 0), 6) AS ap FROM g")
def a15(spark, sf):
    from pyspark.sql import Window

    e = views.table(spark, sf, "events")
    ranked = e.select(F.col("user_id").alias("q"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rk"), (F.col("event_type") == "error").cast("int").alias("rel"))
    return evaluate.ranking(ranked, "q", "rk", "rel")


@query("a17_wilson_interval", "g AS (SELECT s_nationkey AS k, count(*) FILTER (WHERE s_acctbal > 0) AS h, count(*) AS n FROM supplier GROUP BY 1), c AS (SELECT *, h::DOUBLE / n AS p, 1.0::DOUBLE + 3.8416::DOUBLE / n AS d FROM g), m AS (SELECT *, (p + 3.8416::DOUBLE / (2 * n)) / d AS ce, (1.96::DOUBLE / d) * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n)) AS mg FROM c) SELECT k, h, n, round_even(ce - mg, 4) AS low, round_even(ce + mg, 4) AS high FROM m")
def a17(spark, sf):
    g = views.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count_if(F.col("s_acctbal") > 0).alias("h"), F.count("*").alias("n"))
    low, high = S.wilson(F.col("h"), F.col("n"))
    return g.select("k", "h", "n", low.alias("low"), high.alias("high"))


@query("a18_mcnemar", """t AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS a, count(*) FILTER (WHERE quality = 1 AND toxic <> 0) AS b, count(*) FILTER (WHERE quality <> 1 AND toxic = 0) AS c, count(*) FILTER (WHERE quality <> 1 AND toxic <> 0) AS d FROM labels)
SELECT a, b, c, d, round_even(CASE WHEN b + c = 0 THEN 1.0::DOUBLE WHEN b + c < 25 THEN least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))) FROM range(least(b, c) + 1) r(k)))
 ELSE 1 - 2 / sqrt(pi()) * (SELECT sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(x * k / 2000, 2))) * x / 6000 FROM range(2001) r(k)) END, 6) AS p_value FROM (SELECT *, sqrt(pow(abs(b - c) - 1, 2) / (b + c) / 2) AS x FROM t)""")
def a18(spark, sf):
    rows = views.table(spark, sf, "labels")
    return evaluate.mcnemar(rows, F.col("quality") == 1, F.col("toxic") == 0)


@query("a19_mean_and_deviation", "SELECT event_type, round_even(avg(value), 6) AS mean, round_even(coalesce(stddev_samp(value), 0), 6) AS sd, count(*) AS n FROM events GROUP BY 1")
def a19(spark, sf):
    return evaluate.spread(views.table(spark, sf, "events"), ["event_type"], "value")


@query("a22_severity_and_tool_counts", "SELECT severity, tool, count(*) AS n FROM findings GROUP BY GROUPING SETS ((severity), (tool), ())")
def a22(spark, sf):
    return views.findings(spark, sf).groupingSets([["severity"], ["tool"], []], "severity", "tool").agg(F.count("*").alias("n"))


@query("a23_tool_statistics", "SELECT tool, round_even(avg(time_ms), 2) AS avg_time, max(time_ms) AS max_time, min(time_ms) AS min_time, round_even(avg(found), 2) AS avg_found, round_even(count(*) FILTER (WHERE success) * 100.0::DOUBLE / count(*), 2) AS success_rate, count(*) AS runs FROM tool_runs GROUP BY tool")
def a23(spark, sf):
    return views.tool_runs(spark, sf).groupBy("tool").agg(
        F.bround(F.avg("time_ms"), 2).alias("avg_time"), F.max("time_ms").alias("max_time"), F.min("time_ms").alias("min_time"), F.bround(F.avg("found"), 2).alias("avg_found"),
        F.bround(F.count_if("success") * 100.0 / F.count("*"), 2).alias("success_rate"), F.count("*").alias("runs"),
    )


@query("a27_specialization", "c AS (SELECT tool, type, count(*) AS n FROM findings WHERE value > 50 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, tool) AS rn FROM c) SELECT type, tool, n FROM r WHERE rn = 1")
def a27(spark, sf):
    counts = views.findings(spark, sf).where("value > 50").groupBy("tool", "type").agg(F.count("*").alias("n"))
    return rank.top_per(counts, ["type"], [F.desc("n"), F.col("tool")], 1).select("type", "tool", "n")


@query("a37_rescan_deltas", "a AS (SELECT type, count(*) AS n FROM findings WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT type, count(*) AS n FROM findings WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1) SELECT b.type, b.n - coalesce(a.n, 0) AS more FROM b LEFT JOIN a USING (type) WHERE b.n > coalesce(a.n, 0)")
def a37(spark, sf):
    f = views.findings(spark, sf)
    split = f.groupBy("type").agg(F.count_if(F.col("ts") < F.lit("2024-01-15").cast("timestamp")).alias("a"), F.count_if(F.col("ts") >= F.lit("2024-01-15").cast("timestamp")).alias("b"))
    return split.where("b > a").select("type", (F.col("b") - F.col("a")).alias("more"))


@query("a40_metric_kinds", "SELECT user_id, count(*) AS counter, arg_max(value, event_id) AS gauge, round_even(sum(value), 4) AS total FROM events GROUP BY user_id")
def a40(spark, sf):
    return views.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("counter"), F.max_by("value", "event_id").alias("gauge"), F.bround(F.sum("value"), 4).alias("total"))


@query("a42_regression_gate", "b AS (SELECT event_type AS metric, avg(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), c AS (SELECT event_type AS metric, avg(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT metric, round_even((c.v - b.v) / b.v, 6) AS change, CASE WHEN (CASE WHEN metric = 'error' THEN 1 ELSE -1 END) * (c.v - b.v) / b.v > 0.01 THEN 'regression' WHEN (CASE WHEN metric = 'error' THEN 1 ELSE -1 END) * (c.v - b.v) / b.v < -0.01 THEN 'improvement' ELSE 'ok' END AS state FROM b JOIN c USING (metric)")
def a42(spark, sf):
    e = views.table(spark, sf, "events")
    mean = lambda rows: rows.groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return evaluate.regressions(mean(e.where("event_id % 2 = 1")), mean(e.where("event_id % 2 = 0")), 0.01, ("error",))


# ---- text -----------------------------------------------------------------------------------------


@query("t6_keywords", "w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) SELECT doc_id, count(*) FILTER (WHERE length(w) >= 4 AND w NOT IN (" + ", ".join(f"'{x}'" for x in text.STOP_WORDS) + ")) AS n FROM w GROUP BY doc_id")
def t6(spark, sf):
    worded = views.table(spark, sf, "documents").where(F.col("text").rlike("[A-Za-z]"))
    return text.keywords(worded).select("doc_id", F.size("keywords").cast("long").alias("n"))


@query("t7_bm25", "q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS term FROM benchmark WHERE item_id % 100 = 0), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ts FROM documents), n AS (SELECT count(*) AS n, avg(len(ts)) AS m FROM d), tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term) SELECT q.query_id, tf.doc_id, round_even(sum(ln((n.n - df.df + 0.5) / (df.df + 0.5) + 1) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * tf.len / n.m))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL")
def t7(spark, sf):
    """BM25 of every document for the benchmark passages whose id is divisible by 100."""
    asked = views.table(spark, sf, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("terms"))
    return text.bm25(views.table(spark, sf, "documents"), asked)


_RULES = [("mail", "[a-z0-9.]+@[a-z0-9.]+", None), ("phone", r"\+[0-9]+ \([0-9]{3}\)", None), ("license", "License", "MIT"), ("key", "token = ", None), ("shout", "!! [A-Z]+!!", None)]


@query("t16_rule_scan", "h AS (SELECT doc_id, line_no, line, unnest(list_filter([CASE WHEN regexp_matches(line, '[a-z0-9.]+@[a-z0-9.]+') THEN 'mail' END, CASE WHEN regexp_matches(line, '\\+[0-9]+ \\([0-9]{3}\\)') THEN 'phone' END, CASE WHEN regexp_matches(line, 'License') AND NOT regexp_matches(line, 'MIT') THEN 'license' END, CASE WHEN regexp_matches(line, 'token = ') THEN 'key' END, CASE WHEN regexp_matches(line, '!! [A-Z]+!!') THEN 'shout' END], lambda x: x IS NOT NULL)) AS rule FROM doc_lines) SELECT doc_id, line_no, rule FROM h")
def t16(spark, sf):
    return text.scan(views.lines(spark, sf), _RULES)


@query("f19_repo_grep", "SELECT doc_id, line_no FROM doc_lines WHERE regexp_matches(line, '(?i)license') ORDER BY doc_id, line_no LIMIT 50")
def f19(spark, sf):
    from pelagos.operators import filters

    return filters.grep(views.lines(spark, sf), "license", 50).select("doc_id", "line_no")


@query("t8_query_expansion", "SELECT item_id, len(list_distinct(list_concat([lower(text)], CASE WHEN contains(lower(text), 'the') THEN ['article', 'word'] ELSE [] END, CASE WHEN contains(lower(text), 'ing') THEN ['verb', 'word'] ELSE [] END)))::BIGINT AS n FROM benchmark")
def t8(spark, sf):
    out = text.expand(views.table(spark, sf, "benchmark"), {"the": ("article", "word"), "ing": ("verb", "word")}, "text")
    return out.select("item_id", F.size("probes").cast("long").alias("n"))


@query("t13_label_keys", "SELECT role || '{turn=' || turn || ',who=' || role || '}' AS key, count(*) AS n FROM conversations GROUP BY 1")
def t13(spark, sf):
    labels = F.map_from_arrays(F.array(F.lit("who"), F.lit("turn")), F.array("role", F.col("turn").cast("string")))
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return views.table(spark, sf, "conversations").groupBy(F.concat("role", F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("key")).agg(F.count("*").alias("n"))


# ---- vectors --------------------------------------------------------------------------------------

_COSINE = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"
_DOUBLES = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


@query("o16_top_k", f"{_DOUBLES}, s AS (SELECT a.vec_id AS query, b.vec_id, round_even({_COSINE}, 9) AS similarity FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id)::INT AS rank FROM s) SELECT query, vec_id, rank FROM r WHERE rank <= 10")
def o16(spark, sf):
    """Ten nearest rows of every hundredth vector, exact."""
    e = views.table(spark, sf, "embeddings")
    return vectors.top_k(e, e.where("vec_id % 100 = 0"), 10).select("query", "vec_id", "rank")


@query("j10_cosine_join", f"{_DOUBLES} SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round_even({_COSINE}, 9) >= 0.3")
def j10(spark, sf):
    return vectors.pairs_within(views.table(spark, sf, "embeddings"), "label", 0.3).select("a", "b")


@query("t5_vector_norms", "SELECT vec_id, round_even(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length FROM embeddings")
def t5(spark, sf):
    return views.table(spark, sf, "embeddings").select("vec_id", F.bround(S.norm(F.col("embedding")), 6).alias("length"))


@query("t9_rerank", "SELECT event_id, round_even(0.78::DOUBLE * (value / 500) + 0.22::DOUBLE * ((event_id % 10) / 10.0::DOUBLE) + least((event_id % 7) * 0.03::DOUBLE, 0.12::DOUBLE), 6) AS score FROM events")
def t9(spark, sf):
    e = views.table(spark, sf, "events")
    score = vectors.rerank(F.col("value") / 500, (F.col("event_id") % 10) / 10.0, (F.col("event_id") % 7) * 0.03)
    return e.select("event_id", F.bround(score, 6).alias("score"))


# ---- graph ----------------------------------------------------------------------------------------


@query("g3_callers", "SELECT dst AS node, count(*) AS callers FROM edges GROUP BY dst")
def g3(spark, sf):
    return views.edges(spark, sf).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("callers"))


@query("g4_reachability", "r(start, node) AS (SELECT src, src FROM edges WHERE src % 400 = 399 UNION SELECT r.start, e.dst FROM r JOIN edges e ON r.node = e.src) SELECT start, node FROM r")
def g4(spark, sf):
    e = views.edges(spark, sf)
    return graph.reachable(e, e.where("src % 400 = 399").select(F.col("src").alias("start")).distinct())


@query("g5_simple_paths", "p(start, node, path) AS (SELECT DISTINCT src, src, [src] FROM edges WHERE src % 400 = 399 UNION ALL SELECT p.start, e.dst, list_append(p.path, e.dst) FROM p JOIN edges e ON p.node = e.src WHERE NOT list_contains(p.path, e.dst) AND len(p.path) < 8) SELECT start, node AS sink, array_to_string(path, '>') AS path FROM p WHERE node < 10")
def g5(spark, sf):
    e = views.edges(spark, sf)
    starts = e.where("src % 400 = 399").select(F.col("src").alias("start")).distinct()
    sinks = e.where("dst < 10").select(F.col("dst").alias("sink")).distinct()
    out = graph.simple_paths(e, starts, sinks, 8)
    return out.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query("g8_taint", "src AS (SELECT DISTINCT src AS node, 's' || (src % 3) AS label FROM edges WHERE src % 500 = 499), t(node, label, hops) AS (SELECT node, label, 0 FROM src UNION SELECT e.dst, t.label, t.hops + 1 FROM t JOIN edges e ON t.node = e.src WHERE e.dst % 7 <> 0 AND t.hops < 10), h AS (SELECT node, min(hops) AS hops FROM t GROUP BY node) SELECT t.node, min(t.label) AS label, h.hops::INT AS hops FROM t JOIN h ON t.node = h.node AND t.hops = h.hops GROUP BY t.node, h.hops")
def g8(spark, sf):
    e = views.edges(spark, sf)
    sources = e.where("src % 500 = 499").select(F.col("src").alias("node"), F.concat(F.lit("s"), F.col("src") % 3).alias("label")).distinct()
    clean = e.select(F.col("dst").alias("node")).where("node % 7 = 0").distinct()
    return graph.taint(e, sources, clean)


# ---- storage, streams, sinks ----------------------------------------------------------------------


@query("m3_latest_version", "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS version FROM orders GROUP BY 1")
def m3(spark, sf):
    o = views.table(spark, sf, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("version"))
    return storage.latest(o, ["o_custkey"], F.col("version"))


@query("m5_retention", "p AS (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' - INTERVAL 365 DAY) SELECT count(*) AS items, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM p)")
def m5(spark, sf):
    orders = views.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    _, items = storage.retain(orders, views.table(spark, sf, "lineitem"), "l_orderkey", "o_orderdate", F.lit("1999-01-01").cast("timestamp"), 365)
    return items.agg(F.count("*").alias("items"), F.count_distinct("l_orderkey").alias("orders"))


@query("m7_cache_expiry", "c AS (SELECT event_id AS key, ts AS created, ts + INTERVAL 3 DAY AS expires FROM events) SELECT key FROM c WHERE expires > TIMESTAMP '2024-01-28' ORDER BY created DESC, key LIMIT 100")
def m7(spark, sf):
    cache = views.table(spark, sf, "events").select(F.col("event_id").alias("key"), F.col("ts").alias("created"), (F.col("ts") + F.make_dt_interval(F.lit(3))).alias("expires"))
    return storage.evict(storage.unexpired(cache, F.lit("2024-01-28").cast("timestamp")), 100).select("key")


@query("o5_recent_first", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def o5(spark, sf):
    return views.table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(25).select("o_orderkey", "o_orderdate")


@query("x1_tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def x1(spark, sf):
    return streams.tumbling(views.table(spark, sf, "events"), "ts", "1 day", ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("x1_sliding_windows", "w AS (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start, event_type FROM events) SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL")
def x1s(spark, sf):
    return streams.sliding(views.table(spark, sf, "events"), "ts", "1 day", "12 hours", ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("x1_session_windows", "e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", user_id, count(*) AS n FROM s GROUP BY user_id, k")
def x1e(spark, sf):
    out = streams.sessions(views.table(spark, sf, "events"), "ts", "6 hours", ["user_id"])
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("x2_latest_per_type", "SELECT role, arg_max(text, conv_id * 1000 + turn) AS text FROM conversations GROUP BY role")
def x2(spark, sf):
    m = views.table(spark, sf, "conversations").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text")
    return streams.latest_by(m, "role", "seq").select("role", "text")


@query("x3_counts_per_type", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def x3(spark, sf):
    return views.table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("conversations"))


_STEPS = "e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


@query("x8_rate_limit", f"""{_STEPS}, w(event_id, user_id, k, held, ok) AS (SELECT event_id, user_id, k, [t], true FROM e WHERE k = 1
 UNION ALL SELECT event_id, user_id, k, CASE WHEN len(live) < 2 THEN list_append(live, t) ELSE live END, len(live) < 2 FROM (SELECT e.event_id, e.user_id, e.k, e.t, list_filter(w.held, lambda x: x > e.t - 3600000000) AS live FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1))
SELECT event_id, user_id, ok AS accepted FROM w""")
def x8(spark, sf):
    """At most two accepted events of a user in any hour."""
    e = views.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return streams.rate_limit(e, "user_id", "ts", 2, 3600.0).select("event_id", "user_id", "accepted")


@query("x9_daily_quota", "SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS period, count(*) AS used, count(*) > 3 AS over FROM events GROUP BY ALL")
def x9(spark, sf):
    return streams.quota(views.table(spark, sf, "events"), "user_id", "ts", 3).withColumn("period", F.col("period").cast("timestamp_ntz"))


@query("x10_debounce", f"""{_STEPS}, w(event_id, user_id, k, last, ok) AS (SELECT event_id, user_id, k, t, true FROM e WHERE k = 1
 UNION ALL SELECT e.event_id, e.user_id, e.k, CASE WHEN e.t - w.last >= 7200000000 THEN e.t ELSE w.last END, e.t - w.last >= 7200000000 FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT event_id, user_id, ok AS accepted FROM w""")
def x10(spark, sf):
    e = views.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return streams.debounce(e, "user_id", "ts", 7200.0).select("event_id", "user_id", "accepted")


@query("x13_recent_history", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY")
def x13(spark, sf):
    return views.table(spark, sf, "events").where(F.col("ts") >= F.lit("2024-01-30").cast("timestamp") - F.make_dt_interval(F.lit(7))).select("event_id")


@query("k1_sarif_results", f"SELECT type AS rule_id, CASE severity WHEN 'Critical' THEN 'error' WHEN 'High' THEN 'error' WHEN 'Medium' THEN 'warning' ELSE 'note' END AS level, file, greatest(line, 1) AS start_line, round_even(round_even(coalesce(confidence, 1.0) * 100, 6), 1) AS rank, {FINGERPRINT} AS fingerprint FROM findings")
def k1(spark, sf):
    f = views.findings(spark, sf)
    return writers.sarif_results(f).drop("message")


@query("k1_sarif_rules", "SELECT type AS rule_id, 'error' AS level FROM findings GROUP BY type HAVING count(*) FILTER (WHERE severity IN ('Critical', 'High')) > 0")
def k1r(spark, sf):
    return writers.sarif_rules(views.findings(spark, sf))


@query("k2_sonar_issues", "SELECT 'pelagos' AS engine_id, type AS rule_id, CASE severity WHEN 'Critical' THEN 'BLOCKER' WHEN 'High' THEN 'CRITICAL' WHEN 'Medium' THEN 'MAJOR' WHEN 'Low' THEN 'MINOR' ELSE 'INFO' END AS severity, 'VULNERABILITY' AS type, message AS primary_message, file AS file_path, greatest(line, 1) AS start_line FROM findings")
def k2(spark, sf):
    return writers.sonar(views.findings(spark, sf))


@query("k8_flat_export", "SELECT tool, severity, type, file, line, substr(message, 1, 100) AS description FROM findings")
def k8(spark, sf):
    return writers.flat(views.findings(spark, sf))


@query("k4_markdown_summary", "SELECT '| ' || lower(severity) || ' | ' || count(*) || ' |' AS value FROM findings GROUP BY lower(severity)")
def k4(spark, sf):
    return writers.markdown_summary(views.findings(spark, sf))
