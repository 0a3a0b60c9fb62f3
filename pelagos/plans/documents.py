"""Queries over the documents that are read and written: results, labels, manifests, indexes, exports; and over the column
functions that they rest on. Bodies are written by SQL that reads alike in Spark and in the comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pelagos import schema, session
from pelagos.functions import safety
from pelagos.functions import scalars as S
from pelagos.operators import normalize, severity, storage, vectors, vindex
from pelagos.plans import views
from pelagos.plans.registry import cases, query
from pelagos.sinks import writers
from pelagos.sources import readers

_DOUBLES = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def _bodies(spark, sf, body: str, name: str = "body"):
    return views.findings(spark, sf).select("ord", F.expr(body).alias(name))


def _folder(spark) -> str:
    """A new path in the folder that driver and executors share."""
    session.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/documents-{uuid.uuid4().hex}"


_ONE = """'{"type":"' || type || '","severity":"' || severity || '","location":{"file":"' || file || '","line":"' || line || '"}}'"""
_RESULTS = f"""CASE ord % 3 WHEN 0 THEN '{{"results":[{{"tool":"' || tool || '","findings":[' || {_ONE} || ',' || {_ONE} || ']}},{{"tool":"none","findings":[]}}]}}' WHEN 1 THEN '{{"tool":"' || tool || '","findings":[' || {_ONE} || ']}}' ELSE 'no document' END"""


@query("s1_result_documents", "SELECT ord, tool, lower(severity) AS severity, type, file, line, n AS place FROM findings, (VALUES (0), (1)) t(n) WHERE (ord % 3 = 0) OR (ord % 3 = 1 AND n = 0)")
def s1(spark, sf):
    """Findings of result documents in three shapes."""
    rows = readers.parse_results(_bodies(spark, sf, _RESULTS)).select("ord", "tool", F.posexplode("findings").alias("place", "raw"))
    return normalize.normalize(rows).select("ord", "tool", "severity", "type", "file", "line", "place")


_LINES = """CASE WHEN ord % 5 = 0 THEN 'broken {' ELSE '{"text":"' || message || '","label":' || (ord % 2) || ',"weight":' || line || '.5}' END"""


@query("s4_labelled_lines", "SELECT ord, CASE WHEN ord % 5 <> 0 THEN message END AS text, CASE WHEN ord % 5 <> 0 THEN (ord % 2)::INT END AS label, CASE WHEN ord % 5 <> 0 THEN line + 0.5::DOUBLE END AS weight, ord % 5 = 0 AS broken FROM findings")
def s4(spark, sf):
    rows = readers.parse_json_lines(_bodies(spark, sf, _LINES, "value"), "text string, label int, weight double")
    return rows.select("ord", "text", "label", "weight", F.col("_corrupt_record").isNotNull().alias("broken"))


_CSV = "CASE ord % 4 WHEN 0 THEN 'x,2,re,code' WHEN 1 THEN '0,1,re,code' ELSE line + 1 || ',' || (ord % 9) || ',' || type || ',code' END"


@query("s6_bug_log", "SELECT ord, line + 1 AS loc, (ord % 9)::INT AS length, type AS bug_type, 'code' AS approach FROM findings WHERE ord % 4 > 1")
def s6(spark, sf):
    return readers.parse_bug_lines(_bodies(spark, sf, _CSV.replace("line + 1 ||", "(line + 1) ||"), "value"))


@query("s7_labelled_files", "SELECT 'set/' || source || '/' || doc_id || '.sol' AS path, source AS category, length(text) AS n FROM documents")
def s7(spark, sf):
    d = views.table(spark, sf, "documents")
    files = d.select(F.concat(F.lit("set/"), "source", F.lit("/"), "doc_id", F.lit(".sol")).alias("path"), F.col("text").cast("binary").alias("content"))
    return readers.labelled(files).select("path", "category", F.length("text").cast("long").alias("n"))


_MANIFEST = """'[{"name":"n' || k || '","path":"set' || (k % 3) || '/' || k || '.sol","vulnerabilities":[{"category":"reentrancy","lines":[1,' || k || ']},{"category":"other","lines":[]}]},{"name":"gone","path":"no/' || k || '.sol"}]'"""


@query("s8_manifest", "SELECT 'n' || k AS name, 'set' || k % 3 || '/' || k || '.sol' AS path, c AS category, n::INT AS n_lines FROM (SELECT p_partkey AS k FROM part WHERE p_partkey % 2 = 0), (VALUES ('reentrancy', 2), ('other', 0)) t(c, n)")
def s8(spark, sf):
    p = views.table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    files = p.where("k % 2 = 0").select(F.expr("'data/set' || (k % 3) || '/' || k || '.sol'").alias("path"), F.lit("code").alias("text"))
    return readers.parse_manifest(p.select(F.expr(_MANIFEST).alias("body")), files).select("name", "path", "category", F.size("lines").alias("n_lines"))


@query("s9_labelled_set", "SELECT * FROM (VALUES ('reentrancy-eth', 'reentrancy'), ('reentrancy-no-eth', 'reentrancy'), ('tx-origin', 'access-control'), ('unchecked-transfer', 'unchecked-call'), ('timestamp', 'time-manipulation'), ('arithmetic', 'integer-overflow')) t(name, category)")
def s9(spark, sf):
    """A labelled set that lives in the library as a table."""
    return schema.dimension(spark, schema.CATEGORY_EXACT, "name string, category string")


_INCIDENT = """'{"incidents":[{"id":"' || ord || '","name":"i' || line || '","amount_lost_usd":' || (ord * 1000) || ',"vulnerability":"' || type || '"},{"id":"x' || ord || '"}]}'"""


@query("s15_incidents", "SELECT ord::VARCHAR AS id, 'i' || line AS name, ord * 1000 AS amount_lost_usd, type AS vulnerability FROM findings UNION ALL SELECT 'x' || ord, NULL, NULL, NULL FROM findings")
def s15(spark, sf):
    return readers.parse_incidents(_bodies(spark, sf, _INCIDENT)).select("id", "name", "amount_lost_usd", "vulnerability")


_CORPUS = "CASE ord % 5 WHEN 0 THEN 'SWC-107: x' WHEN 1 THEN 'swc-999' WHEN 2 THEN 'Time Manipulation' WHEN 3 THEN '' ELSE 'Bad_Randomness' END"


@query("s16_labelled_layouts", "SELECT file, line, CASE ord % 5 WHEN 0 THEN 'reentrancy' WHEN 2 THEN 'time-manipulation' WHEN 4 THEN 'bad-randomness' ELSE 'other' END AS category FROM findings WHERE line > 0")
def s16(spark, sf):
    f = views.findings(spark, sf).select("file", F.col("line").cast("string").alias("at"), F.expr(_CORPUS).alias("label"))
    return readers.labelled_layout(f, "file", "at", "label")


_PLUGINS = """'{"plugins":[{"name":"p' || ord || '","version":"1.' || (ord % 7) || CASE WHEN ord % 3 = 0 THEN '' ELSE '.0' END || '","type":"detector","verification":"' || CASE WHEN ord % 2 = 0 THEN 'verified' ELSE 'none' END || '","tags":["b","a"]},{"name":"","version":"1.0.0"}]}'"""


@query("s18_plugin_index", "SELECT ord, 'p' || ord AS name, '1.' || ord % 7 || '.0' AS version, 'detector' AS type, ord % 2 = 0 AS verified, 'a,b' AS tags FROM findings WHERE ord % 3 <> 0")
def s18(spark, sf):
    return readers.parse_plugins(_bodies(spark, sf, _PLUGINS)).withColumn("tags", F.array_join("tags", ","))


@query("s14_vector_index", f"{_DOUBLES}, s AS (SELECT q.vec_id AS query, v.vec_id, round_even(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 9) AS similarity FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id)::INT AS rank FROM s) SELECT query, vec_id, rank FROM r WHERE rank <= 5")
def s14(spark, sf):
    """An index under centroids is written, half of the rows are added to it later, and all of its lists are searched."""
    path, rows = _folder(spark), views.table(spark, sf, "embeddings")
    vindex.build(rows.where("vec_id % 2 = 0"), path, lists=16)
    vindex.add(rows.where("vec_id % 2 = 1"), path)
    return vindex.search(spark, path, rows.where("vec_id % 100 = 0"), 5, None).select("query", "vec_id", "rank")


@query("s14_probed_recall", "SELECT 48 AS probes, count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def s14_probed(spark, sf):
    """Whether probing 48 of 64 lists finds nine tenths of the exact neighbours at least."""
    path, rows = _folder(spark), views.table(spark, sf, "embeddings")
    vindex.build(rows, path)
    asked = rows.where("vec_id % 100 = 0")
    measured = vindex.recall(vindex.search(spark, path, asked, 10, 48), vindex.search(spark, path, asked, 10, None))
    return measured.agg(F.lit(48).alias("probes"), F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("enough"))


# ---- sinks ----------------------------------------------------------------------------------------


@query("k3_xml_export", "SELECT type, severity, file, line::BIGINT AS line FROM findings")
def k3(spark, sf):
    """Written as XML and read again."""
    path = _folder(spark)
    writers.export(views.findings(spark, sf), "checkmarx", path)
    shape = "_name string, _Severity string, Result struct<_FileName:string,_Line:long,_VALUE:string>"
    rows = spark.read.format("xml").option("rowTag", "Query").schema(shape).load(path)
    return rows.select(F.col("_name").alias("type"), F.col("_Severity").alias("severity"), F.col("Result._FileName").alias("file"), F.col("Result._Line").alias("line"))


@query("k9_jsonl_export", "SELECT ord, tool, severity, type, file, line, confidence FROM findings")
def k9(spark, sf):
    path = _folder(spark)
    writers.export(views.findings(spark, sf).select("ord", "tool", "severity", "type", "file", "line", "confidence"), "jsonl", path)
    return spark.read.schema("ord long, tool string, severity string, type string, file string, line int, confidence double").json(path)


@query("k16_baseline_snapshot", "SELECT count(*) AS n FROM (SELECT DISTINCT type, file, function FROM findings)")
def k16(spark, sf):
    """Messages differ from each other by line references only, so that a function's type has one fingerprint."""
    path = _folder(spark)
    writers.export(views.findings(spark, sf), "baseline", path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


@query("k5_report_documents", """SELECT file, '{"metadata":{"total_findings":' || count(*) || ',"tools":["' || array_to_string(list_sort(list(DISTINCT tool)), '","') || '"]},"summary":{"critical":' || count(*) FILTER (WHERE severity = 'Critical') || ',"high":' || count(*) FILTER (WHERE severity = 'High') || ',"medium":' || count(*) FILTER (WHERE severity = 'Medium') || ',"low":' || count(*) FILTER (WHERE severity = 'Low') || ',"info":' || count(*) FILTER (WHERE severity = 'Info') || '}}' AS value FROM findings GROUP BY file""")
def k5(spark, sf):
    return writers.report(views.findings(spark, sf))


_PLACE = f"{cases('lower(severity)', schema.SEVERITY_RANK, '5')}"


@query("k6_annotations", f"""t AS (SELECT *, {_PLACE} AS rk FROM findings ORDER BY rk DESC, ord LIMIT 20) SELECT '::' || CASE WHEN rk >= 8 THEN 'error' WHEN rk >= 5 THEN 'warning' ELSE 'notice' END || ' file=' || file || ',line=' || line || '::' || message AS value FROM t UNION ALL SELECT (count(*) - 20) || ' further findings' FROM findings""")
def k6(spark, sf):
    return writers.annotations(views.findings(spark, sf), 20)


@query("k11_batch_lines", "SELECT file || ',' || CASE WHEN count(*) FILTER (WHERE severity IN ('Critical', 'High')) > 0 THEN 'failed' ELSE 'passed' END || ',' || count(*) FILTER (WHERE severity = 'Critical') || ',' || count(*) FILTER (WHERE severity = 'High') || ',' || count(*) FILTER (WHERE severity = 'Medium') || ',' || count(*) FILTER (WHERE severity = 'Low') || ',' || count(*) FILTER (WHERE severity = 'Info') AS value FROM findings GROUP BY file")
def k11(spark, sf):
    return writers.batch(views.findings(spark, sf))


@query("k12_result_lines", """SELECT type AS rule, file, greatest(line, 1) AS line, message FROM findings""")
def k12(spark, sf):
    """Each result as one JSON object, taken apart again."""
    shape = "ruleId string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>"
    place = F.get("x.locations", F.lit(0))["physicalLocation"]
    rows = writers.sarif_lines(views.findings(spark, sf)).select(F.from_json("value", shape).alias("x"))
    return rows.select(F.col("x.ruleId").alias("rule"), place["artifactLocation"]["uri"].alias("file"), place["region"]["startLine"].alias("line"), F.col("x.message.text").alias("message"))


@query("k14_metric_lines", "SELECT 'findings{severity=\"' || severity || '\",tool=\"' || tool || '\"} ' || count(*) || '.0' AS value FROM findings GROUP BY severity, tool")
def k14(spark, sf):
    n = views.findings(spark, sf).groupBy("tool", "severity").agg(F.count("*").cast("double").alias("value"))
    return writers.prometheus(n.select(F.lit("findings").alias("name"), F.create_map(F.lit("tool"), "tool", F.lit("severity"), "severity").alias("labels"), "value"))


@query("k17_badges", """SELECT file, '{"schemaVersion":1,"label":"security","message":"' || least(count(*), 100) || '/100 (' || CASE WHEN count(*) >= 90 THEN 'A' WHEN count(*) >= 80 THEN 'B' WHEN count(*) >= 70 THEN 'C' WHEN count(*) >= 60 THEN 'D' ELSE 'F' END || ')"}' AS value FROM findings GROUP BY file""")
def k17(spark, sf):
    n = views.findings(spark, sf).groupBy("file").agg(F.least(F.count("*"), F.lit(100)).alias("n"))
    return n.select("file", writers.badge(F.col("n"), S.grade(F.col("n"))).alias("value"))


_CHAT = {
    "alpaca": """'{"instruction":"' || type || '","input":"' || message || '","output":"' || severity || '"}'""",
    "chatml": """'{"messages":[{"role":"user","content":"' || type || '\\n\\n' || message || '"},{"role":"assistant","content":"' || severity || '"}]}'""",
    "sharegpt": """'{"conversations":[{"from":"human","value":"' || type || '\\n\\n' || message || '"},{"from":"gpt","value":"' || severity || '"}]}'""",
}
for _style, _line in _CHAT.items():

    @query(f"k18_chat_{_style}", f"SELECT {_line.replace(chr(92) * 2, chr(92))} AS value FROM findings")
    def k18(spark, sf, style=_style):
        rows = views.findings(spark, sf).select(F.col("type").alias("instruction"), F.col("message").alias("context"), F.col("severity").alias("response"))
        return writers.chat(rows, style)


@query("k19_feedback_lines", """SELECT ord, '{"type":"' || type || '","severity":"' || lower(severity) || '","tool":"' || tool || '","label":' || CASE ord % 3 WHEN 0 THEN 1 ELSE 0 END || '}' AS value FROM findings WHERE ord % 3 < 2""")
def k19(spark, sf):
    verdict = F.when(F.col("ord") % 3 == 0, "true_positive").when(F.col("ord") % 3 == 1, "false_positive").otherwise("unsure")
    lines = writers.feedback(views.findings(spark, sf).withColumn("verdict", verdict))
    # The confidence, whose digits engines write differently, is left out of the comparison.
    return lines.select("ord", F.regexp_replace("value", r'"confidence":[^,]*,', "").alias("value"))


@query("k20_experiment_record", """SELECT 'run' AS name, '{"seed":"7"}' AS parameters, count(*) AS n FROM findings""")
def k20(spark, sf):
    return writers.experiment(views.findings(spark, sf), "run", {"seed": "7"}).drop("checksum")


@query("k21_editor_diagnostics", "SELECT ord, file, greatest(line, 1) - 1 AS start_line, greatest(line, 1) - 1 AS end_line, CASE severity WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 1 END AS severity, type AS code, message FROM findings WHERE severity <> 'Info'")
def k21(spark, sf):
    return writers.diagnostics(views.findings(spark, sf), 3)


# ---- column functions -----------------------------------------------------------------------------


_REFERENCE = "CASE ord % 6 WHEN 0 THEN line || '-' || (line + 4) WHEN 1 THEN 'L' || line WHEN 2 THEN '-' || line WHEN 3 THEN '' WHEN 4 THEN 'none' ELSE '' || line END"


@query("p10_line_references", "SELECT ord, CASE WHEN ord % 6 IN (0, 1, 5) THEN line ELSE 0 END AS line FROM findings")
def p10(spark, sf):
    return _bodies(spark, sf, _REFERENCE, "at").select("ord", S.safe_line(F.col("at")).alias("line"))


_CONFIDENCE = "CASE ord % 6 WHEN 0 THEN 'High' WHEN 1 THEN ' medium ' WHEN 2 THEN '1.5' WHEN 3 THEN '-2' WHEN 4 THEN 'odd' END"


@query("p11_confidences", "SELECT ord, CASE ord % 6 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 WHEN 4 THEN 0.7 END::DOUBLE AS confidence FROM findings")
def p11(spark, sf):
    return _bodies(spark, sf, _CONFIDENCE, "c").select("ord", S.safe_confidence(F.col("c")).alias("confidence"))


@query("p13_messages_without_places", "SELECT ord, type || ' in ' || function || '() ()' AS message FROM findings")
def p13(spark, sf):
    return views.findings(spark, sf).select("ord", S.normalize_message(F.col("message")).alias("message"))


@query("p17_levels_and_grades", "SELECT ord, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS level, CASE WHEN line >= 90 THEN 'A' WHEN line >= 80 THEN 'B' WHEN line >= 70 THEN 'C' WHEN line >= 60 THEN 'D' ELSE 'F' END AS grade FROM findings WHERE confidence IS NOT NULL")
def p17(spark, sf):
    return views.findings(spark, sf).where("confidence is not null").select("ord", S.confidence_level(F.col("confidence")).alias("level"), S.grade(F.col("line")).alias("grade"))


def _ladder(x: str, ladder: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {least} THEN '{name}'" for least, name in severity.LADDERS[ladder]) + " ELSE 'info' END"


@query("p19_severity_ladders", f"SELECT ord, {_ladder('c', 'prediction')} AS predicted, {_ladder('c', 'classification')} AS classified, {_ladder('c * 10', 'cvss')} AS rated FROM (SELECT ord, confidence AS c FROM findings WHERE confidence IS NOT NULL)")
def p19(spark, sf):
    c = F.col("confidence")
    rows = views.findings(spark, sf).where("confidence is not null")
    return rows.select("ord", severity.by_ladder(c, "prediction").alias("predicted"), severity.by_ladder(c, "classification").alias("classified"), severity.by_ladder(c * 10, "cvss").alias("rated"))


_EITHER = (("reentrancy", "re"), ("tx-origin-check", "or"), ("unchecked", "un"), ("time", "ti"))


@query("p7_either_contains", "SELECT ord, CASE " + " ".join(f"WHEN contains(type, '{k}') OR contains('{k}', type) THEN '{v}'" for k, v in _EITHER) + " ELSE 'none' END AS kind FROM findings")
def p7(spark, sf):
    """Types by the first name that contains them or that they contain."""
    return views.findings(spark, sf).select("ord", severity.either_contains(F.col("type"), _EITHER, "none").alias("kind"))


_STATUS = "CASE ord % 6 WHEN 0 THEN 'passed' WHEN 1 THEN ' FAILED ' WHEN 2 THEN 'timeout' WHEN 3 THEN 'odd' WHEN 4 THEN 'no_tests' END"


@query("p33_prover_statuses", "SELECT ord, CASE ord % 6 WHEN 0 THEN 'verified' WHEN 1 THEN 'violated' WHEN 2 THEN 'timeout' WHEN 3 THEN 'odd' WHEN 4 THEN 'no_tests' ELSE 'unavailable' END AS status FROM findings")
def p33(spark, sf):
    return _bodies(spark, sf, _STATUS, "s").select("ord", severity.prover_status(F.col("s")).alias("status"))


@query("p27_sanitized_text", "SELECT ord, 'a &lt;system&gt;' || type || '&lt;/system&gt;' AS text FROM findings")
def p27(spark, sf):
    return _bodies(spark, sf, "'a <system>' || type || '</system>'", "t").select("ord", safety.sanitize(F.col("t")).alias("text"))


@query("p2_whole_location", "SELECT ord, CASE WHEN ord % 2 = 0 THEN '' ELSE file END AS file, CASE WHEN ord % 2 = 0 THEN 5 ELSE line END AS line, CASE WHEN ord % 3 = 0 THEN 0.7 ELSE 0.25 END::DOUBLE AS confidence FROM findings")
def p2(spark, sf):
    """The correlation's reading: a location, if there is one, wins whole, and a missing confidence is 0.7."""
    body = """'{"type":"' || type || '",' || CASE WHEN ord % 2 = 0 THEN '"location":{"line":"5"},' ELSE '' END || CASE WHEN ord % 3 = 0 THEN '' ELSE '"confidence":"0.25",' END || '"file":"' || file || '","line":"' || line || '"}'"""
    rows = normalize.parse(_bodies(spark, sf, body, "raw").withColumn("tool", F.lit("t")))
    return normalize.normalize(rows, 0.7, whole_location=True).select("ord", "file", "line", "confidence")


@query("u1_flattened_results", "SELECT ord, n AS place, type FROM findings, (VALUES (0), (1)) t(n) WHERE ord % 3 = 0")
def u1(spark, sf):
    docs = _bodies(spark, sf, _RESULTS).where("ord % 3 = 0")
    flat = normalize.flatten(readers.parse_results(docs).withColumn("contract", F.col("ord").cast("string")))
    return flat.select(F.col("contract").cast("long").alias("ord"), F.col("ord").alias("place"), F.col("raw.type").alias("type"))


@query("m4_point_lookup", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey IN (SELECT p_partkey FROM part WHERE p_partkey % 50 = 1)")
def m4(spark, sf):
    """Rows of stated keys; the keys' filter reaches the scan where they are few."""
    keys = views.table(spark, sf, "part").where("p_partkey % 50 = 1").select(F.col("p_partkey").alias("o_orderkey"))
    return views.table(spark, sf, "orders").join(keys, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("m1_appended_table", "SELECT severity, count(*) AS n FROM findings GROUP BY severity")
def m1(spark, sf):
    """Findings appended in two writes to a table partitioned by severity, and counted there."""
    path = _folder(spark)
    f = views.findings(spark, sf).select("ord", "type", "severity")
    for part in (f.where("ord % 2 = 0"), f.where("ord % 2 = 1")):
        storage.append(part, path, ["severity"])
    return spark.read.schema("ord long, type string, severity string").parquet(path).groupBy("severity").agg(F.count("*").alias("n"))
