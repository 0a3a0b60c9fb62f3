"""Readers: every one gives a DataFrame with a fixed schema and leaves the work to the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagos import schema


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """``ord, body``: whole files as text, ``ord`` a hash of the path."""
    return spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("ord"), F.col("value").alias("body"))


def parse_results(docs: DataFrame) -> DataFrame:
    """Rows of results of ``docs(ord, body)``: a list under ``results``, else one result at the top. Bodies that do not parse
    give a result without findings."""
    shape = f"struct<results:array<{schema.TOOL_RESULT}>,findings:array<{schema.RAW_FINDING}>,tool:string,contract:string,status:string>"
    d = docs.select("ord", F.from_json("body", shape).alias("d")).select("ord", "d.*")
    own = F.array(F.from_json(F.to_json(F.struct("tool", "contract", "status", "findings")), schema.TOOL_RESULT))
    return d.select("ord", F.explode(F.when(F.size("results") > 0, F.col("results")).otherwise(own)).alias("r")).select("ord", "r.*")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Documents of tool results: a list under ``results``, findings at the top, or one result; one row per result."""
    return parse_results(bodies(spark, path)).drop("ord")


def parse_json_lines(lines: DataFrame, columns: str) -> DataFrame:
    """``ord`` and ``columns`` of ``lines(ord, value)``; what does not parse is kept in ``_corrupt_record``."""
    parsed = F.from_json("value", f"{columns}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select("ord", parsed.alias("x")).select("ord", "x.*")


def json_lines(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """JSON lines; lines that do not parse are kept in ``_corrupt_record``."""
    return spark.read.schema(f"{columns}, _corrupt_record string").json(path)


def _bug_rows(rows: DataFrame, *keep: str) -> DataFrame:
    typed = rows.select(*keep, F.col("loc").try_cast("int").alias("loc"), F.col("length").try_cast("int").alias("length"), F.col("`bug type`").alias("bug_type"), "approach")
    return typed.where("loc > 0 and length is not null")


def parse_bug_lines(lines: DataFrame) -> DataFrame:
    """``ord, loc, length, bug_type, approach`` of CSV ``lines(ord, value)`` without their head; lines without a positive
    place are left out."""
    parsed = F.from_csv("value", "loc string, length string, `bug type` string, approach string")
    return _bug_rows(lines.select("ord", parsed.alias("x")).select("ord", "x.*"), "ord")


def bug_log(spark: SparkSession, path: str) -> DataFrame:
    """``loc, length, bug_type, approach`` from CSV logs; rows without a positive line are left out."""
    return _bug_rows(spark.read.option("header", True).csv(path))


def labelled(files: DataFrame) -> DataFrame:
    """``path, category, text`` of ``files(path, content)``: the folder's name, and bytes as text (what is no UTF-8 replaced)."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("category"), text.alias("text"))


def labelled_folders(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, byte for byte, with the name of their folder as ``category``."""
    return labelled(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def parse_manifest(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Annotated datasets: entries of ``docs(ord, body)`` joined to the ``files(path, text)`` there are, one row per weakness."""
    shape = "array<struct<name:string,path:string,pragma:string,source:string,vulnerabilities:array<struct<category:string,lines:array<int>>>>>"
    entries = docs.select(F.explode(F.from_json("body", shape)).alias("e")).select("e.*")
    # A file stands for every tail of its path, so that entries and files meet by equality.
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    joined = entries.join(files.select(F.explode(tails).alias("path"), "text"), "path")
    return joined.select("name", "path", "text", F.explode_outer("vulnerabilities").alias("v")).select("name", "path", "text", "v.category", "v.lines")


def manifest(spark: SparkSession, manifest_path: str, files: DataFrame) -> DataFrame:
    return parse_manifest(bodies(spark, manifest_path), files)


def parse_incidents(docs: DataFrame) -> DataFrame:
    """One row per incident of ``docs(ord, body)``."""
    shape = "struct<incidents:array<struct<id:string,name:string,`date`:string,amount_lost_usd:long,chain:string,vulnerability:string,swc:string,description:string>>>"
    return docs.select(F.explode(F.from_json("body", shape)["incidents"]).alias("i")).select("i.*")


def incidents(spark: SparkSession, path: str) -> DataFrame:
    return parse_incidents(bodies(spark, path))


def parse_plugins(docs: DataFrame) -> DataFrame:
    """One row per plugin of index ``docs(ord, body)``: name, version, type, whether verified, tags; plugins without a name or
    with a version that is not three numbers are left out."""
    shape = "struct<plugins:array<struct<name:string,version:string,type:string,verification:string,tags:array<string>>>>"
    rows = docs.select("ord", F.explode(F.from_json("body", shape)["plugins"]).alias("p")).select("ord", "p.*")
    return rows.where((F.col("name") != "") & F.col("version").rlike(r"^[0-9]+[.][0-9]+[.][0-9]+$")).select(
        "ord", "name", "version", "type", F.coalesce(F.col("verification") == "verified", F.lit(False)).alias("verified"), F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags")
    )


#: Category of a weakness number in labelled corpora.
SWC_CATEGORY = {"SWC-101": "arithmetic", "SWC-104": "unchecked-call", "SWC-105": "access-control", "SWC-107": "reentrancy", "SWC-114": "front-running", "SWC-116": "time-manipulation", "SWC-120": "bad-randomness"}


def labelled_layout(rows: DataFrame, file: str, line: str, label: str) -> DataFrame:
    """``file, line, category``: labels of any corpus in one layout; weakness numbers go by ``SWC_CATEGORY``, names in lower case
    with dashes, and rows without a file or a positive line are left out."""
    raw = F.trim(F.coalesce(F.col(label), F.lit("")))
    number = F.upper(F.regexp_extract(raw, r"(?i)(swc-[0-9]+)", 1))
    named = F.regexp_replace(F.lower(raw), r"[ _]+", "-")
    known = F.create_map(*[F.lit(x) for pair in SWC_CATEGORY.items() for x in pair])
    category = F.when(number != "", F.coalesce(F.try_element_at(known, number), F.lit("other"))).otherwise(F.when(named != "", named).otherwise("other"))
    at = F.col(line).try_cast("int")
    return rows.where((F.col(file) != "") & (at > 0)).select(F.col(file).alias("file"), at.alias("line"), category.alias("category"))


def tool_outputs(spark: SparkSession, path: str) -> DataFrame:
    """``ord, tool, contract, body`` of captured outputs in folders named after their tools, for ``tools.collect``."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    return files.select(F.xxhash64("path").alias("ord"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("tool"), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("contract"), "body")
