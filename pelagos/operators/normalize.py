"""From tool output to canonical finding rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos import schema
from pelagos.functions import scalars as S


def parse(rows: DataFrame, column: str = "raw") -> DataFrame:
    """Parse a JSON column as a raw finding; what does not parse is a null struct, which ``normalize`` leaves out."""
    return rows.withColumn(column, F.from_json(column, schema.RAW_FINDING, {"mode": "PERMISSIVE"}))


def flatten(results: DataFrame) -> DataFrame:
    """Tool results to one row per finding, ``tool`` from the result and ``ord`` the place in it."""
    return results.select("tool", "contract", F.posexplode("findings").alias("ord", "raw"))


def normalize(rows: DataFrame, default_confidence: float = 1.0, whole_location: bool = False) -> DataFrame:
    """``rows(tool, raw, ...)`` to the finding columns; other columns stay.

    Each field is the first of its names that is not null (severity, impact; type, check, name; ...). A missing
    severity is medium, a missing type unknown, a missing confidence ``default_confidence``. With ``whole_location`` a
    nested location wins whole: what it lacks is not looked up beside it.
    """
    raw = lambda *names: F.coalesce(*[F.col(f"raw.{n}") for n in names])
    text = lambda c, default: F.coalesce(S.blank_to_null(c), F.lit(default))
    rest = [c for c in rows.columns if c not in ("raw", "tool")]
    beside = lambda c: F.when(F.col("raw.location").isNull(), c) if whole_location else c
    picked = rows.where(F.col("raw").isNotNull()).select(
        *rest,
        "tool",
        S.normalize_severity(F.coalesce(raw("severity", "impact"), F.lit("medium"))).alias("severity"),
        text(raw("type", "check", "name"), "unknown").alias("type"),
        F.coalesce(raw("message", "description", "title"), F.lit("")).alias("message"),
        F.coalesce(F.col("raw.location.file"), beside(F.coalesce("raw.filename", "raw.file")), F.lit("")).alias("file"),
        S.safe_line(F.coalesce(F.col("raw.location.line"), beside(F.coalesce("raw.lineno", "raw.line")))).alias("line"),
        F.coalesce(F.col("raw.location.function"), beside(F.col("raw.function")), F.lit("")).alias("function"),
        raw("swc_id", "swc").alias("swc_id"),
        raw("cwe_id", "cwe").alias("cwe_id"),
        F.coalesce(S.safe_confidence(F.col("raw.confidence")), F.lit(default_confidence)).alias("confidence"),
    )
    identity = S.finding_id(F.col("tool"), F.col("type"), F.col("file"), F.col("line").cast("string"), F.substring("message", 1, 100))
    return picked.withColumn("id", identity).withColumn("type", F.lower("type"))
