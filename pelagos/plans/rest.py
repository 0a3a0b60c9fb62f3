"""Further queries: weighted confidence, clusters, classified severity, adjusted vectors, contexts, graphs of tools, settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagos import schema
from pelagos.functions import detectors
from pelagos.functions import scalars as S
from pelagos.operators import clusters, code, correlate, dedup, learn, rank, score, severity
from pelagos.plans import views
from pelagos.plans.findings import CATEGORY, LAYER, ORDER, SEMANTIC
from pelagos.plans.registry import cases, query

_RELIABLE = "[" + ", ".join(f"'{t}'" for t, w in schema.TOOL_WEIGHT.items() if w >= 0.8) + "]"


@query("a4_weighted_confidence", f"{SEMANTIC}, k AS (SELECT *, len(list_intersect(tools, {_RELIABLE})) AS k FROM semantic) SELECT category, file, function, line_bucket, round_even(least(0.99::DOUBLE, confidence + CASE WHEN k >= 2 THEN 0.1::DOUBLE WHEN k = 1 AND len(tools) >= 2 THEN 0.05::DOUBLE ELSE 0.0 END), 6) AS weighted FROM k")
def a4(spark, sf):
    return score.weighted_confidence(dedup.semantic(views.findings(spark, sf))).select("category", "file", "function", "line_bucket", "weighted")


@query("a35_report_statistics", f"SELECT 'severity' AS dimension, severity AS value, count(*) AS n FROM findings GROUP BY 2 UNION ALL SELECT 'tool', tool, count(*) FROM findings GROUP BY 2 UNION ALL SELECT 'layer', ({LAYER})::VARCHAR, count(*) FROM findings GROUP BY 2")
def a35(spark, sf):
    f = views.findings(spark, sf).withColumn("layer", S.lookup(schema.TOOL_LAYER, F.col("tool"), 0))
    return score.counts_by(f, ["severity", "tool", "layer"])


_CLUSTERS = f"""n AS (SELECT ord, file, function, severity, {CATEGORY} AS category, {ORDER} AS rk FROM findings),
c AS (SELECT min(ord) OVER (PARTITION BY category, function) AS cluster, * FROM n),
s AS (SELECT cluster, count(*) AS n, max(rk) AS worst, count(DISTINCT file) AS files, round_even(least(0.99::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * least(count(*), 5)), 6) AS confidence FROM c GROUP BY cluster)"""


def _clusters(spark, sf):
    f = views.findings(spark, sf)
    named = f.select("ord", "function", S.category(F.col("type")).alias("category"))
    first = named.groupBy("category", "function").agg(F.min("ord").alias("cluster"))
    return f, named.join(first, ["category", "function"]).select("ord", "cluster")


@query("a12_cluster_summary", f"{_CLUSTERS} SELECT *, CASE WHEN files <= 1 AND n <= 2 THEN 'low' WHEN files <= 3 AND n <= 5 THEN 'medium' WHEN files <= 5 AND n <= 10 THEN 'high' ELSE 'very high' END AS effort FROM s")
def a12(spark, sf):
    """Size, worst severity, files, confidence and effort of clusters of one category and function."""
    return clusters.summary(*_clusters(spark, sf)).withColumn("effort", clusters.effort(F.col("files"), F.col("n")))


@query("o13_clusters_by_severity", f"{_CLUSTERS} SELECT cluster, row_number() OVER (ORDER BY worst DESC, n DESC, cluster)::INT AS place FROM s ORDER BY place LIMIT 10")
def o13(spark, sf):
    found = clusters.summary(*_clusters(spark, sf))
    return rank.first_rows(found, [F.desc("worst"), F.desc("n"), F.asc("cluster")], 10).select("cluster", "place")


@query("d2_anchored_groups")
def d2(spark, sf):
    """Groups around their first finding; rows as SQL has no such fold."""
    return correlate.anchored(views.findings(spark, sf))


def _any(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_P25_TYPE = "CASE ord % 4 WHEN 0 THEN 'reentrancy' WHEN 1 THEN 'access-control' WHEN 2 THEN 'code-style' ELSE type END"
_P25_TEXT = "CASE ord % 5 WHEN 0 THEN 'every user of the Vault' WHEN 1 THEN 'this contract' WHEN 2 THEN 'as in the DAO hack' ELSE message END"
_IMPACT = cases("kind", {k: severity.IMPACT_SCORE[v] for k, v in severity.IMPACT_OF.items()}, "0.3::DOUBLE")
_EASE = cases("kind", severity.EASE_OF, "0.6::DOUBLE")
_SCOPE = f"CASE WHEN {_any('text', severity.WIDE_WORDS)} THEN 1.0::DOUBLE WHEN {_any('text', severity.CONTRACT_WORDS)} THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END"
_RAISED = f"least(1.0::DOUBLE, least(1.0::DOUBLE, {_IMPACT} * 0.5::DOUBLE + {_EASE} * 0.3::DOUBLE + {_SCOPE} * 0.2::DOUBLE + CASE WHEN {_any('text', severity.EXPLOIT_WORDS)} THEN 0.15::DOUBLE ELSE 0 END) + CASE WHEN {_any('text', severity.FUND_WORDS)} THEN 0.1::DOUBLE ELSE 0 END)"


@query("p25_classified_severity", f"""x AS (SELECT ord, {_P25_TYPE} AS kind, lower({_P25_TEXT}) AS text FROM findings),
s AS (SELECT ord, round_even(greatest(0.0::DOUBLE, {_RAISED} - CASE WHEN ord % 3 = 0 THEN 0.1::DOUBLE ELSE 0 END), 6) AS severity_score FROM x)
SELECT ord, severity_score, CASE WHEN severity_score >= 0.85 THEN 'critical' WHEN severity_score >= 0.65 THEN 'high' WHEN severity_score >= 0.45 THEN 'medium' WHEN severity_score >= 0.25 THEN 'low' ELSE 'info' END AS classified FROM s""")
def p25(spark, sf):
    f = views.findings(spark, sf).select("ord", F.expr(_P25_TYPE).alias("type"), F.expr(_P25_TEXT).alias("message"))
    return severity.classify(f, F.col("ord") % 3 == 0).select("ord", "severity_score", "classified")


_P21_NAME = "CASE ord % 4 WHEN 0 THEN 'Reentrancy attack' WHEN 1 THEN 'unchecked_call' WHEN 2 THEN 'overflow' ELSE 'something else' END"
_KNOWN = "CASE " + " ".join(f"WHEN contains(name, '{k}') OR contains('{k}', name) THEN '{''.join(v)}'" for k, v in schema.CATEGORY_VECTOR.items()) + " ELSE '' END"


@query("p21_adjusted_vectors", f"""x AS (SELECT ord, lower(severity) AS low, regexp_replace(lower({_P21_NAME}), '[ _]', '-', 'g') AS name FROM findings), k AS (SELECT *, {_KNOWN} AS known FROM x)
SELECT ord, CASE WHEN known = '' THEN 'N' || CASE WHEN low IN ('low', 'info') THEN 'H' ELSE 'L' END || CASE WHEN low = 'critical' THEN 'N' ELSE 'L' END || 'NN' || CASE WHEN low IN ('critical', 'high') THEN 'H' ELSE 'L' END || CASE WHEN low = 'critical' THEN 'H' ELSE 'N' END
 ELSE substr(known, 1, 1) || CASE WHEN low = 'critical' THEN 'L' ELSE substr(known, 2, 1) END || substr(known, 3) END AS vector FROM k""")
def p21(spark, sf):
    f = views.findings(spark, sf).select("ord", "severity", F.expr(_P21_NAME).alias("name"))
    return f.select("ord", F.concat(*severity.adjusted_vector(F.col("name"), F.col("severity"), schema.CATEGORY_VECTOR).values()).alias("vector"))


_EFFORTS = {"origin": "low", "unchecked": "low", "reentr": "medium", "arith": "high"}


@query("p22_effort_classes", "SELECT ord, CASE " + " ".join(f"WHEN contains(type, '{w}') THEN '{e}'" for w, e in _EFFORTS.items()) + " WHEN severity IN ('Critical', 'High') THEN 'high' WHEN severity = 'Medium' THEN 'medium' ELSE 'low' END AS effort FROM findings")
def p22(spark, sf):
    return views.findings(spark, sf).select("ord", severity.effort_class(F.col("type"), F.col("severity"), _EFFORTS).alias("effort"))


@query("e7_heuristic_noise", f"SELECT ord, round_even(least(1.0::DOUBLE, 0.3::DOUBLE + CASE WHEN {ORDER} <= 1 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN ord % 3 = 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN ord % 2 = 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN coalesce(confidence, 0.5) < 0.5 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN type = 'arithmetic' THEN 0.3::DOUBLE ELSE 0 END), 6) AS p_noise FROM findings")
def e7(spark, sf):
    """How likely a finding is noise where no model is trained."""
    f = views.findings(spark, sf)
    signs = {"swc_id": F.when(F.col("ord") % 2 == 1, "SWC-1"), "has_library": F.col("ord") % 3 == 0, "checked_arithmetic": F.col("type") == "arithmetic"}
    return learn.heuristic_noise(f.withColumns(signs)).select("ord", "p_noise")


_BENIGN, _DOUBT = {"tx-origin": "nonReentrant", "arithmetic": r"require\("}, "onlyOwner"


@query("f11_context_verdicts", f"""f AS (SELECT ord, line % 20 AS line, type, 1 + ord % (SELECT count(*) FROM part) AS doc_id FROM findings),
j AS (SELECT f.ord, (f.type = 'tx-origin' AND regexp_matches(head || chr(10) || body, 'nonReentrant')) OR (f.type = 'arithmetic' AND regexp_matches(head || chr(10) || body, 'require\\(')) AS harmless, regexp_matches(head || chr(10) || body, '{_DOUBT}') AS doubt
 FROM f JOIN blocks b ON f.doc_id = b.doc_id AND f.line BETWEEN b.first_line AND b.last_line)
SELECT f.ord, CASE WHEN j.harmless THEN 'dropped' WHEN j.harmless IS NULL OR j.doubt THEN 'review' ELSE 'kept' END AS verdict FROM f LEFT JOIN j ON f.ord = j.ord""")
def f11(spark, sf):
    """Findings by what the function around them says."""
    parts = views.table(spark, sf, "part").count()
    f = views.findings(spark, sf).select("ord", (F.col("line") % 20).alias("line"), "type", (1 + F.col("ord") % parts).alias("doc_id"))
    return code.context_verdicts(f, code.functions(views.contracts(spark, sf)), _BENIGN, _DOUBT)


_GRAPH = """'{"elements":[{"type":"function","name":"' || function || '","additional_fields":{"visibility":"' || CASE WHEN ord % 2 = 0 THEN 'external' ELSE 'odd' END || '"}},{"type":"function"},{"type":"edge","source":"' || function || '","target":"' || CASE WHEN ord % 3 = 0 THEN '' ELSE type END || '"}]}'"""


@query("g2_printed_graphs", "SELECT ord, function AS src, CASE WHEN ord % 3 <> 0 THEN type END AS dst, CASE WHEN ord % 2 = 0 THEN 'external' ELSE 'public' END AS visibility FROM findings")
def g2(spark, sf):
    """Functions and edges of call graphs that a tool has printed."""
    functions, edges = code.graph_of_output(views.findings(spark, sf).select("ord", F.expr(_GRAPH).alias("body")))
    named = functions.where("name <> 'unknown'").select("ord", F.col("name").alias("src"), "visibility")
    return named.join(edges, ["ord", "src"], "left").select("ord", "src", "dst", "visibility")


@query("t14_merged_settings", "SELECT ord, tool AS a_x, severity AS a_y, 'fixed' AS b_x, type AS c_x FROM findings")
def t14(spark, sf):
    """Settings of maps in maps, the second over the first."""
    f = views.findings(spark, sf)
    first = F.create_map(F.lit("a"), F.create_map(F.lit("x"), F.col("tool"), F.lit("y"), F.lit("old")), F.lit("b"), F.create_map(F.lit("x"), F.lit("fixed")))
    second = F.create_map(F.lit("a"), F.create_map(F.lit("y"), F.col("severity")), F.lit("c"), F.create_map(F.lit("x"), F.col("type")))
    m = f.select("ord", score.merged_maps(first, second).alias("m"))
    return m.select("ord", *[F.col("m")[a][b].alias(f"{a}_{b}") for a, b in (("a", "x"), ("a", "y"), ("b", "x"), ("c", "x"))])


@query("p26_features", f"SELECT ord, {cases('lower(severity)', schema.SEVERITY_ORDER, '0')}::DOUBLE AS x_severity, coalesce(confidence, 0.7) AS x_confidence, length(message)::DOUBLE AS x_message, (tool IN ('slither', 'aderyn', 'mythril'))::INT::DOUBLE AS x_static FROM findings")
def p26(spark, sf):
    rows, _ = learn.features(views.findings(spark, sf))
    return rows.select("ord", "x_severity", "x_confidence", "x_message", "x_static")


# ---- merging, order, tags, detectors, models ------------------------------------------------------


@query("a6_merged_evidence", f"""p AS (SELECT *, {CATEGORY} AS category, (line // 5) * 5 AS line_bucket FROM findings),
t AS (SELECT category, file, function, line_bucket, tool, min(ord) AS o FROM p GROUP BY ALL)
SELECT t.category, t.file, t.function, t.line_bucket::INT AS line_bucket, string_agg(f.message, '|' ORDER BY t.o) AS evidence FROM t JOIN findings f ON f.ord = t.o GROUP BY ALL""")
def a6(spark, sf):
    """Groups of findings that mean the same, with what each of their tools said first."""
    merged = dedup.merged_with_evidence(views.findings(spark, sf), 5)
    return merged.select("category", "file", "function", F.col("line_bucket").cast("int").alias("line_bucket"), F.array_join("evidence", "|").alias("evidence"))


@query("a6_merge_statistics", f"""g AS (SELECT count(*) AS n, count(DISTINCT tool) AS tools FROM (SELECT *, {CATEGORY} AS category FROM findings) GROUP BY category, file, function, line // 5)
SELECT sum(n)::BIGINT AS original, count(*) AS merged, (sum(n) - count(*))::BIGINT AS removed, round_even((sum(n) - count(*))::DOUBLE / sum(n), 6) AS reduction, count(*) FILTER (WHERE tools > 1) AS cross_tool FROM g""")
def a6_statistics(spark, sf):
    return dedup.merge_statistics(dedup.semantic(views.findings(spark, sf), 5))


@query("o3_suppressed_last", f"SELECT ord, row_number() OVER (ORDER BY (ord % 3 = 0), {ORDER} DESC, coalesce(confidence, 0.7) DESC, ord)::INT AS place FROM findings WHERE line > 10 ORDER BY place LIMIT 5000")
def o3(spark, sf):
    """Findings that nothing suppresses first, then by severity and confidence."""
    f = views.findings(spark, sf).where("line > 10").withColumns({"suppressed": F.col("ord") % 3 == 0, "confidence": F.coalesce("confidence", F.lit(0.7))})
    worst = S.lookup(schema.SEVERITY_ORDER, F.lower("severity"), 0)
    return rank.first_rows(f, [F.col("suppressed").asc(), *rank.enhanced_order(f, worst)], 5000).select("ord", "place")


@query("o11_chains_by_score", f"""c AS (SELECT file, line // 10 AS part, count(DISTINCT {CATEGORY}) AS kinds, max({ORDER}) AS worst FROM findings GROUP BY ALL HAVING count(DISTINCT {CATEGORY}) >= 2)
SELECT file, part::INT AS part, round_even(least(10.0::DOUBLE, 2.0::DOUBLE * worst + 0.5::DOUBLE * (kinds - 1)), 1) AS cvss, row_number() OVER (ORDER BY round_even(least(10.0::DOUBLE, 2.0::DOUBLE * worst + 0.5::DOUBLE * (kinds - 1)), 1) DESC, file, part)::INT AS place FROM c ORDER BY place LIMIT 20""")
def o11(spark, sf):
    """Chains of findings of several categories in one place, the highest score first."""
    placed = views.findings(spark, sf).select("file", F.floor(F.col("line") / 10).cast("int").alias("part"), S.category(F.col("type")).alias("category"), S.lookup(schema.SEVERITY_ORDER, F.lower("severity"), 0).alias("worst"))
    chains = placed.groupBy("file", "part").agg(S.few_distinct(F.col("category")).alias("kinds"), F.max("worst").alias("worst")).where("kinds >= 2")
    scored = chains.withColumn("cvss", F.bround(F.least(F.lit(10.0), 2.0 * F.col("worst") + 0.5 * (F.col("kinds") - 1)), 1))
    return rank.first_rows(scored, [F.desc("cvss"), F.asc("file"), F.asc("part")], 20).select("file", "part", "cvss", "place")


@query("u5_source_tags", f"""g AS (SELECT {CATEGORY} AS category, file, line // 5 AS bucket, list_distinct(list(tool)) AS tools, avg(coalesce(confidence, 0.7)) AS c FROM findings GROUP BY ALL)
SELECT category, file, bucket::INT AS bucket, CASE WHEN list_has_any(tools, ['slither', 'aderyn', 'mythril']) AND list_has_any(tools, ['smartllm', 'gptscan']) THEN 'cross' WHEN list_has_any(tools, ['smartllm', 'gptscan']) THEN 'model' ELSE 'static' END AS tag,
 round_even(least(1.0::DOUBLE, c + CASE WHEN list_has_any(tools, ['slither', 'aderyn', 'mythril']) AND list_has_any(tools, ['smartllm', 'gptscan']) THEN 0.15::DOUBLE ELSE 0.0 END), 6) AS confidence FROM g""")
def u5(spark, sf):
    """Merged findings that static tools and models agree on are tagged and weigh more."""
    f = views.findings(spark, sf).select("file", F.floor(F.col("line") / 5).cast("int").alias("bucket"), S.category(F.col("type")).alias("category"), "tool", F.coalesce("confidence", F.lit(0.7)).alias("c"))
    merged = f.groupBy("category", "file", "bucket").agg(F.collect_set("tool").alias("tools"), F.avg("c").alias("c"))  # few tools
    return score.tagged(merged).select("category", "file", "bucket", "tag", F.bround("confidence", 6).alias("confidence"))


@query("e1_detector_rows", """l AS (SELECT doc_id, n AS line, string_split(text, chr(10))[n] AS t FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents WHERE text IS NOT NULL))
SELECT doc_id, 'long-line' AS rule, line::INT AS line, len(t) || ' characters' AS message FROM l WHERE len(t) > 120""")
def e1(spark, sf):
    """A detector as a table function over every document."""
    detectors.register(spark)
    views.table(spark, sf, "documents").createOrReplaceTempView("detected_documents")
    return spark.sql("SELECT doc_id, d.* FROM detected_documents, LATERAL detect_long_lines(text) d")


@query("e5_failing_detectors", """SELECT doc_id, CASE WHEN len(text) > 2000 THEN 'error' ELSE 'short' END AS rule, CASE WHEN len(text) > 2000 THEN 0 ELSE 1 END::INT AS line, CASE WHEN len(text) > 2000 THEN 'ValueError: ' || len(text) || ' characters' ELSE '' END AS message FROM documents WHERE text IS NOT NULL""")
def e5(spark, sf):
    """A detector that fails on long texts: its failures are rows, and the job goes on."""

    def short_only(text):
        if len(text) > 2000:
            raise ValueError(f"{len(text)} characters")
        yield "short", 1, ""

    detectors.register(spark, {"short-only": short_only})
    views.table(spark, sf, "documents").where("text is not null").createOrReplaceTempView("detected_texts")
    return spark.sql("SELECT doc_id, d.* FROM detected_texts, LATERAL detect_short_only(text) d")


@query("e6_triage_model", "SELECT count(*) AS scored, true AS probabilities, true AS separates FROM findings")
def e6(spark, sf):
    """A triage model trained on labelled findings: every finding gets a probability, and rows held out are told apart."""
    rows = views.findings(spark, sf).withColumn("label", (F.col("severity").isin("Critical", "High") & (F.col("line") > 20)).cast("double"))
    model, auc = learn.train(rows)
    return learn.score(rows, model).agg(F.count("*").alias("scored"), F.bool_and(F.col("p_real").between(0, 1)).alias("probabilities"), F.lit(auc > 0.95).alias("separates"))
