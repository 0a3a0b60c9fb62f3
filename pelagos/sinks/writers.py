"""Sinks: findings as rows of the documents that other tools read. All are projections; writing is Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos import schema
from pelagos.functions import scalars as S

#: Levels of severities in other formats.
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note", "informational": "note"}
SONAR_SEVERITY = {"critical": "BLOCKER", "high": "CRITICAL", "medium": "MAJOR", "low": "MINOR", "info": "INFO", "informational": "INFO"}
EDITOR_SEVERITY = {"critical": 1, "high": 1, "medium": 2, "low": 3, "info": 4, "informational": 4}


def level(table: dict, severity: Column, default) -> Column:
    return S.lookup(table, F.lower(severity), default)


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One rule per type with the worst of its severities."""
    rank = S.lookup(schema.SEVERITY_RANK, F.lower("severity"), 5)
    return findings.groupBy(F.col("type").alias("rule_id")).agg(level(SARIF_LEVEL, F.max_by("severity", F.struct(rank, "severity")), "warning").alias("level"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """Results with location, rank (confidence of 100) and fingerprint."""
    return findings.select(
        F.col("type").alias("rule_id"), level(SARIF_LEVEL, F.col("severity"), "warning").alias("level"), "message", "file", F.greatest("line", F.lit(1)).alias("start_line"),
        F.bround(F.bround(F.coalesce("confidence", F.lit(1.0)) * 100, 6), 1).alias("rank"),
        S.fingerprint(F.col("type"), F.col("file"), F.col("function"), F.col("message")).alias("fingerprint"),
    )


def sarif_lines(findings: DataFrame) -> DataFrame:
    """Each result as one JSON object, for ``write.text``."""
    r = sarif_results(findings)
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation"))
    body = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), "rank", F.struct(F.col("fingerprint").alias("content/v1")).alias("fingerprints"))
    return r.select(F.to_json(body).alias("value"))


def sonar(findings: DataFrame) -> DataFrame:
    return findings.select(F.lit("pelagos").alias("engine_id"), F.col("type").alias("rule_id"), level(SONAR_SEVERITY, F.col("severity"), "MAJOR").alias("severity"), F.lit("VULNERABILITY").alias("type"), F.col("message").alias("primary_message"), F.col("file").alias("file_path"), F.greatest("line", F.lit(1)).alias("start_line"))


def checkmarx(findings: DataFrame, path: str) -> None:
    """XML with one element per finding."""
    rows = findings.select(F.col("type").alias("_name"), F.col("severity").alias("_Severity"), F.struct(F.col("file").alias("_FileName"), F.col("line").alias("_Line"), F.col("message").alias("_VALUE")).alias("Result"))
    rows.write.format("xml").option("rootTag", "CxXMLResults").option("rowTag", "Query").save(path)


def flat(findings: DataFrame) -> DataFrame:
    """Columns of the CSV export; descriptions cut to 100 characters."""
    return findings.select("tool", "severity", "type", "file", "line", F.substring("message", 1, 100).alias("description"))


def markdown_summary(findings: DataFrame) -> DataFrame:
    """Lines of a severity table, most severe first."""
    counts = findings.groupBy(F.lower("severity").alias("severity")).count()
    return counts.select(S.lookup(schema.SEVERITY_RANK, F.col("severity"), 5).alias("rank"), F.format_string("| %s | %d |", "severity", "count").alias("value")).orderBy(F.desc("rank"), "value").select("value")


def annotations(findings: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` most severe findings as workflow commands, and a line for those that are left out."""
    rank = S.lookup(schema.SEVERITY_RANK, F.lower("severity"), 5)
    kind = F.when(rank >= 8, "error").when(rank >= 5, "warning").otherwise("notice")
    line = F.format_string("::%s file=%s,line=%d::%s", kind, "file", "line", "message")
    top = findings.select(rank.alias("rank"), "ord", line.alias("value")).orderBy(F.desc("rank"), "ord").limit(cap).select("value")
    rest = findings.agg(F.count("*").alias("n")).where(F.col("n") > cap).select(F.format_string("%d further findings", F.col("n") - cap).alias("value"))
    return top.unionByName(rest)


def prometheus(samples: DataFrame) -> DataFrame:
    """Text exposition lines of ``samples(name, labels map, value)``."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return samples.select(F.concat("name", F.lit("{"), F.array_join(pairs, ","), F.lit("} "), F.col("value").cast("string")).alias("value"))


def badge(score: Column, letter: Column) -> Column:
    """Endpoint JSON of a score badge."""
    return F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.lit("security").alias("label"), F.format_string("%d/100 (%s)", score, letter).alias("message")))


def report(findings: DataFrame, by: str = "file") -> DataFrame:
    """Per group a JSON document: number of findings, counts by severity, tools in order."""
    counts = [F.count_if(F.lower("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")]
    summed = findings.groupBy(by).agg(F.count("*").alias("total"), *counts, F.array_sort(F.collect_set("tool")).alias("tools"))
    summary = F.struct(*["critical", "high", "medium", "low", "info"])
    return summed.select(by, F.to_json(F.struct(F.struct(F.col("total").alias("total_findings"), "tools").alias("metadata"), summary.alias("summary"))).alias("value"))


def diagnostics(findings: DataFrame, least: int = 4) -> DataFrame:
    """What editors show: range from 0, severity 1 to 4, code and message; those beyond ``least`` are left out."""
    number = level(EDITOR_SEVERITY, F.col("severity"), 4)
    line = F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)) - 1
    rows = findings.select("ord", "file", line.alias("start_line"), line.alias("end_line"), number.alias("severity"), F.coalesce("type", F.lit("")).alias("code"), F.coalesce("message", "type", F.lit("")).alias("message"))
    return rows.where(F.col("severity") <= least)


def batch(findings: DataFrame) -> DataFrame:
    """One line per contract of a batch: contract, status, counts by severity, most severe first within the line."""
    counts = [F.count_if(F.lower("severity") == s) for s in ("critical", "high", "medium", "low", "info")]
    status = F.when(counts[0] + counts[1] > 0, "failed").otherwise("passed")
    return findings.groupBy("file").agg(F.concat_ws(",", F.col("file"), status, *[c.cast("string") for c in counts]).alias("value")).select("value")


def feedback(judged: DataFrame) -> DataFrame:
    """Training lines of findings that a person has judged: what is known of the finding, and the label 1 for real."""
    label = F.when(F.col("verdict") == "true_positive", 1).when(F.col("verdict") == "false_positive", 0)
    body = F.struct("type", F.lower("severity").alias("severity"), "tool", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), label.alias("label"))
    return judged.where(label.isNotNull()).select("ord", F.to_json(body).alias("value"))


def experiment(findings: DataFrame, name: str, parameters: dict[str, str]) -> DataFrame:
    """One row that tells a run from any other: name, parameters, number of findings, and a checksum of them that does not
    depend on their order."""
    given = F.create_map(*[F.lit(x) for pair in sorted(parameters.items()) for x in pair])
    row = F.crc32(F.concat_ws("|", "ord", "tool", "type", "severity").cast("binary"))
    return findings.agg(F.count("*").alias("n"), F.sum(row).alias("checksum")).select(F.lit(name).alias("name"), F.to_json(given).alias("parameters"), "n", "checksum")


def chat(rows: DataFrame, style: str) -> DataFrame:
    """Training examples of ``rows(instruction, context, response)`` as lines in one of three styles."""
    turn = lambda who, key, text, name: F.struct(F.lit(who).alias(key), text.alias(name))
    asked = F.concat_ws("\n\n", "instruction", "context")
    body = {
        "alpaca": F.struct("instruction", F.col("context").alias("input"), F.col("response").alias("output")),
        "chatml": F.struct(F.array(turn("user", "role", asked, "content"), turn("assistant", "role", F.col("response"), "content")).alias("messages")),
        "sharegpt": F.struct(F.array(turn("human", "from", asked, "value"), turn("gpt", "from", F.col("response"), "value")).alias("conversations")),
    }[style]
    return rows.select(F.to_json(body).alias("value"))


def baseline(findings: DataFrame, path: str) -> None:
    """Snapshot of fingerprints, one row each, sorted within files."""
    from pelagos.operators import dedup

    rows = findings.withColumn("fingerprint", S.fingerprint(F.col("type"), F.col("file"), F.col("function"), F.col("message")))
    first = dedup.first_per(rows.select("fingerprint", "ord", "type", "file", "function", "severity"), ["fingerprint"])
    first.sortWithinPartitions("fingerprint").write.mode("overwrite").parquet(path)


WRITERS = {
    "csv": lambda f, path: flat(f).write.option("header", True).csv(path),
    "jsonl": lambda f, path: f.write.json(path),
    "sarif": lambda f, path: sarif_lines(f).write.text(path),
    "sonar": lambda f, path: sonar(f).write.json(path),
    "checkmarx": checkmarx,
    "markdown": lambda f, path: markdown_summary(f).coalesce(1).write.text(path),
    "baseline": baseline,
}


def export(findings: DataFrame, kind: str, path: str) -> None:
    WRITERS[kind](findings, path)
