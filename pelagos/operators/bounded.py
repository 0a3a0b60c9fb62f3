"""Limits for nested JSON: a body is walked level by level as VARIANT values, and one value beyond a limit rejects it whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos import session

#: What stored bodies are held to.
DEPTH, LIST_ITEMS, OBJECT_KEYS, TEXT_CHARS, KEY_CHARS = 8, 100, 100, 5_000, 120
#: Control characters that no text may hold, and directions that would show it otherwise than it is.
UNSAFE = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\u202a-\\u202e\\u2066-\\u2069]"


def violations(docs: DataFrame, key: str = "id", body: str = "body", depth: int = DEPTH, items: int = LIST_ITEMS, keys: int = OBJECT_KEYS, chars: int = TEXT_CHARS) -> DataFrame:
    """``(key, path, reason)`` of every value beyond a limit: ``depth`` (values nested deeper), ``items`` and ``keys`` (a list
    or object has more), ``text`` (longer, or with unsafe characters), ``key`` (empty, or longer than allowed), ``json`` (the
    body is none, or null).

    As many rounds as ``depth`` has levels and one; each explodes the values that are lists or objects, a level a round.
    """
    session.ensure_checkpoint_dir(docs.sparkSession)
    spark = docs.sparkSession
    parsed = docs.select(F.col(key).alias("id__"), F.try_parse_json(body).alias("v__"))
    found = [parsed.where("v__ is null").select("id__", F.lit("$").alias("path"), F.lit("json").alias("reason"))]
    kind = F.schema_of_variant("v__")
    level = parsed.where("v__ is not null").select("id__", F.lit("$").alias("path__"), "v__")
    for at in range(depth + 1):
        rows = level.select("id__", "path__", "v__", kind.alias("kind__"))
        text = F.expr("try_variant_get(v__, '$', 'string')")
        bad = (F.col("kind__") == "STRING") & ((F.length(text) > chars) | text.rlike(UNSAFE))
        found.append(rows.where(bad).select("id__", F.col("path__").alias("path"), F.lit("text").alias("reason")))
        rows.where("kind__ LIKE 'ARRAY%' OR kind__ LIKE 'OBJECT%'").createOrReplaceTempView("bounded_level")
        inner = spark.sql("SELECT id__, path__, kind__, e.pos, e.key, e.value FROM bounded_level, LATERAL variant_explode(v__) e").checkpoint()
        limit = F.when(F.col("kind__").startswith("ARRAY"), items).otherwise(keys)
        path = F.concat("path__", F.when(F.col("key").isNull(), F.concat(F.lit("["), "pos", F.lit("]"))).otherwise(F.concat(F.lit("."), "key")))
        many = F.when(F.col("kind__").startswith("ARRAY"), "items").otherwise("keys")
        found.append(inner.where(F.col("pos") == limit).select("id__", F.col("path__").alias("path"), many.alias("reason")))
        wrong = (F.length("key") > KEY_CHARS) | (F.trim("key") == "") | F.col("key").rlike(UNSAFE)
        found.append(inner.where(wrong).select("id__", F.col("path__").alias("path"), F.lit("key").alias("reason")))
        if at == depth:
            found.append(inner.select("id__", F.col("path__").alias("path"), F.lit("depth").alias("reason")).distinct())
        level = inner.where(F.col("pos") < limit).select("id__", path.alias("path__"), F.col("value").alias("v__"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("id__", key)


def within_limits(docs: DataFrame, key: str = "id", body: str = "body", **limits: int) -> DataFrame:
    """The rows of ``docs`` whose ids have no violation."""
    wrong = violations(docs, key, body, **limits).select(F.col(key).alias("wrong__")).distinct()
    return docs.join(wrong, F.col(key).eqNullSafe(F.col("wrong__")), "left_anti")
