"""Queries of layers, patterns, links, chains, caches and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagos import schema
from pelagos.functions import scalars as S
from pelagos.operators import graph, joins, vectors
from pelagos.plans import views
from pelagos.plans.findings import LAYER, PENALTY, WEIGHT
from pelagos.plans.registry import query

_DOUBLES = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


@query("j11_pattern_match", f"{_DOUBLES}, p AS (SELECT label AS pattern, arg_min(e, vec_id) AS e FROM v GROUP BY label) SELECT v.vec_id, p.pattern FROM v, p WHERE round_even(list_dot_product(v.e, p.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(p.e, p.e))), 9) >= 0.3")
def j11(spark, sf):
    """Vectors that are like one of the patterns, the first vector of each label: a table of as many rows as labels."""
    e = views.table(spark, sf, "embeddings")
    patterns = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("p")).withColumnRenamed("label", "pattern")
    if patterns.count() > 1000:
        raise ValueError("more than 1,000 patterns: search them by vectors.top_k")
    cosine = F.bround(S.dot(F.col("embedding"), F.col("p")) / (S.norm(F.col("embedding")) * S.norm(F.col("p"))), 9)
    return e.join(F.broadcast(patterns), cosine >= 0.3).select("vec_id", "pattern")


@query("j16_counterexample_links", "c AS (SELECT ord AS proof, file, line FROM findings WHERE tool = 'mythril'), f AS (SELECT ord, file, line FROM findings WHERE tool = 'slither') SELECT c.proof, min(f.ord) AS ord FROM c JOIN f ON c.file = f.file AND c.line = f.line GROUP BY c.proof")
def j16(spark, sf):
    f = views.findings(spark, sf).select("ord", "tool", "file", "line")
    proofs = f.where("tool = 'mythril'").select(F.col("ord").alias("proof"), "file", "line")
    return proofs.join(f.where("tool = 'slither'"), ["file", "line"]).groupBy("proof").agg(F.min("ord").alias("ord"))


@query("a32_report_risk_by_layer", f"SELECT {LAYER} AS layer, count(*) AS n, round_even(sum({PENALTY}), 4) AS risk FROM findings GROUP BY 1")
def a32(spark, sf):
    penalty = S.lookup(schema.SEVERITY_PENALTY, F.lower("severity"), 5.0)
    layer = S.lookup(schema.TOOL_LAYER, F.col("tool"), 0)
    return views.findings(spark, sf).groupBy(layer.alias("layer")).agg(F.count("*").alias("n"), F.bround(F.sum(penalty), 4).alias("risk"))


@query("a33_layer_by_severity", f"l AS (SELECT {LAYER} AS layer, severity FROM findings) SELECT layer, severity, count(*) AS n FROM l GROUP BY CUBE (layer, severity)")
def a33(spark, sf):
    f = views.findings(spark, sf).select(S.lookup(schema.TOOL_LAYER, F.col("tool"), 0).alias("layer"), "severity")
    return f.cube("layer", "severity").agg(F.count("*").alias("n"))


@query("a41_cache_statistics", "SELECT event_type, count(*) AS entries, sum(value > 50)::BIGINT AS hits, round_even(sum(value > 50)::DOUBLE / count(*), 6) AS hit_rate, min(ts) AS oldest FROM events GROUP BY 1")
def a41(spark, sf):
    e = views.table(spark, sf, "events")
    hits = F.count_if(F.col("value") > 50)
    return e.groupBy("event_type").agg(F.count("*").alias("entries"), hits.alias("hits"), F.bround(hits / F.count("*"), 6).alias("hit_rate"), F.min("ts").alias("oldest"))


@query("f3_confident_selection", f"SELECT ord FROM (SELECT ord, file, line, {WEIGHT} AS w, confidence FROM findings) WHERE confidence >= 0.7 AND w >= 0.7")
def f3(spark, sf):
    f = views.findings(spark, sf)
    return f.where((F.col("confidence") >= 0.7) & (S.lookup(schema.TOOL_WEIGHT, F.col("tool"), 0.5) >= 0.7)).select("ord")


@query("f5_cross_validated", "SELECT file, line, type FROM findings GROUP BY ALL HAVING count(DISTINCT tool) >= 2")
def f5(spark, sf):
    return views.findings(spark, sf).groupBy("file", "line", "type").agg(S.few_distinct(F.col("tool")).alias("k")).where("k >= 2").select("file", "line", "type")


@query("f18_registry_filter", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0 AND s_nationkey IN (1, 2, 3) AND s_name LIKE 'Supplier#%'")
def f18(spark, sf):
    s = views.table(spark, sf, "supplier")
    return s.where((F.col("s_acctbal") > 0) & F.col("s_nationkey").isin(1, 2, 3) & F.col("s_name").startswith("Supplier#")).select("s_suppkey", "s_name")


@query("g6_guarded_paths", "p(start, node, path) AS (SELECT DISTINCT src, src, [src] FROM edges WHERE src % 400 = 399 UNION ALL SELECT p.start, e.dst, list_append(p.path, e.dst) FROM p JOIN edges e ON p.node = e.src WHERE NOT list_contains(p.path, e.dst) AND len(p.path) < 5) SELECT start, node AS sink, count(*) AS paths, count(*) FILTER (WHERE len(list_filter(path, lambda x: x % 5 = 0)) = 0) AS unguarded FROM p WHERE node % 10 = 3 GROUP BY start, node")
def g6(spark, sf):
    """Paths of at most five nodes to external calls, and how many of them pass no guard."""
    e = views.edges(spark, sf)
    starts = e.where("src % 400 = 399").select(F.col("src").alias("start")).distinct()
    sinks = e.where("dst % 10 = 3 or src % 10 = 3").select(F.explode(F.array("src", "dst")).alias("sink")).where("sink % 10 = 3").distinct()
    paths = graph.simple_paths(e, starts, sinks, 5)
    open_path = ~F.exists("path", lambda x: x % 5 == 0)
    return paths.groupBy("start", "sink").agg(F.count("*").alias("paths"), F.count_if(open_path).alias("unguarded"))


@query("o7_top_severe", "SELECT ord, severity, message FROM findings WHERE severity IN ('Critical', 'High') ORDER BY CASE severity WHEN 'Critical' THEN 0 ELSE 1 END, ord LIMIT 10")
def o7(spark, sf):
    f = views.findings(spark, sf).where(F.col("severity").isin("Critical", "High"))
    return f.orderBy(F.when(F.col("severity") == "Critical", 0).otherwise(1), "ord").limit(10).select("ord", "severity", "message")


@query("j4_tolerance_recall", "t AS (SELECT ord, file, line, type FROM findings WHERE tool = 'mythril'), d AS (SELECT file, line, type FROM findings WHERE tool = 'slither') SELECT type, count(*) AS truth, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM d WHERE d.file = t.file AND d.type = t.type AND abs(d.line - t.line) <= 5)) AS found FROM t GROUP BY type")
def j4(spark, sf):
    f = views.findings(spark, sf).select("ord", "tool", "file", "line", "type")
    truth = f.where("tool = 'mythril'")
    met = joins.band_join(truth, f.where("tool = 'slither'"), ["file", "type"], 5, "left_semi").select("ord", F.lit(1).alias("hit"))
    return truth.join(met, "ord", "left").groupBy("type").agg(F.count("*").alias("truth"), F.count("hit").alias("found"))


@query("d8_sub_clusters")
def d8(spark, sf):
    from pelagos.operators import clusters

    return clusters.sub_clusters(views.findings(spark, sf))


@query("t4_unit_vectors", f"{_DOUBLES} SELECT vec_id, round_even(e[1] / sqrt(list_dot_product(e, e)), 6) AS first, round_even(e[64] / sqrt(list_dot_product(e, e)), 6) AS last FROM v")
def t4(spark, sf):
    u = vectors.unit(views.table(spark, sf, "embeddings"))
    return u.select("vec_id", F.bround(F.get("embedding", F.lit(0)), 6).alias("first"), F.bround(F.get("embedding", F.lit(63)), 6).alias("last"))
