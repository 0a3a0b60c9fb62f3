"""Line dedup by log templates, in DataFrame functions only.

A fixed-depth tree sorts lines into leaves by their number of tokens and their first ``depth`` tokens, variable
tokens (those with a digit) masked. In a leaf the tokens that few documents have at their position are variable
fields too; a line whose unmasked tokens are constant in a share that is high enough is an instance of its leaf's
template, and templates that recur across documents are dropped from all but the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.llm import common

FIELD = "<*>"
#: Tokens with a digit in them: numbers, dates, addresses, keys.
VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*"


def _masked(line: Column) -> Column:
    """``line`` with variable tokens masked and every white space character a blank."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, VARIABLE, FIELD)).otherwise(line)
    return F.translate(masked, "\t\x0b\f\r", "    ")


def _tokens(masked: Column) -> Column:
    parts = F.split(masked, " ")
    spaced = masked.contains("  ") | masked.startswith(" ") | masked.endswith(" ") | (masked == "")
    return F.when(spaced, F.filter(parts, lambda t: t != "")).otherwise(parts)


def _keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, d, tag, text)``: d orders documents (nulls first), d and tag name their texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("tag"), "text"
    )


def _places(keyed: DataFrame, depth: int) -> DataFrame:
    """One row per line that has a token: its number, its leaf and the hash ``h`` of its masked text.

    Lines are parsed inside the array that is exploded, so each is parsed once whatever is filtered afterwards.
    """

    def parsed(line: Column) -> Column:
        leaf = lambda t: F.xxhash64(F.size(t), F.slice(t, 1, depth)).alias("leaf")
        tokens = lambda m: common.let(_tokens(m), lambda t: F.struct(F.size(t).alias("n"), leaf(t), F.xxhash64(m).alias("h")))
        return common.let(_masked(line), tokens)

    rows = keyed.select("d", "tag", F.posexplode(F.transform(F.split("text", "\n"), parsed)).alias("line_no", "x")).where("x.n > 0")
    return rows.select("d", "tag", "line_no", "x.leaf", "x.h")


def _templates(places: DataFrame, keyed: DataFrame, min_docs: int, similarity: float) -> DataFrame:
    """``(h, template)`` of the lines that are instances of a template."""
    docs = places.select("d", "tag", "leaf", "h").distinct()
    busy = docs.groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf")
    known = common.materialize(docs.join(busy, "leaf", "left_semi").groupBy("leaf", "h").agg(F.count("*").alias("docs")), "known")
    # The texts of those lines only: a second reading that needs no more than each line's hash.
    hashed = lambda line: common.let(_masked(line), lambda m: F.struct(m.alias("masked"), F.xxhash64(m).alias("h")))
    wanted = keyed.select(F.explode(F.transform(F.split("text", "\n"), hashed)).alias("x")).select("x.h", "x.masked")
    texts = wanted.join(common.small_or_shuffled(known), "h").groupBy("leaf", "h", "docs").agg(F.first("masked").alias("masked"))
    texts = common.materialize(texts.withColumn("masked", F.array_join(_tokens(F.col("masked")), " ")), "texts")
    cells = texts.select("leaf", "h", "docs", F.posexplode(F.split("masked", " ")).alias("pos", "token"))
    constant = cells.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("support")).where((F.col("support") >= min_docs) & (F.col("token") != FIELD))
    seen = cells.join(constant, ["leaf", "pos", "token"], "left").select(
        "leaf",
        "h",
        "pos",
        F.when(F.col("support").isNull(), FIELD).otherwise(F.col("token")).alias("token"),
        F.when(F.col("token") != FIELD, F.col("support").isNotNull().cast("int")).alias("constant"),
    )
    built = seen.groupBy("leaf", "h").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("cells"), F.avg("constant").alias("share"))
    return built.where(F.col("share") >= similarity).select("h", F.xxhash64("leaf", F.col("cells.token")).alias("template"))


def recurring(docs: DataFrame, min_docs: int = 5, depth: int = 3, similarity: float = 0.75) -> DataFrame:
    """``(d, tag, dropped)``: numbers of the lines to drop, in order, for each text that loses any."""
    keyed = _keyed(docs)
    places = common.materialize(_places(keyed, depth), "lines")
    templates = common.materialize(_templates(places, keyed, min_docs, similarity), "templates")
    of = places.join(common.small_or_shuffled(templates), "h").select("d", "tag", "line_no", "template")
    counted = of.select("template", "d", "tag").distinct().groupBy("template").agg(F.count("*").alias("docs"), F.min(F.struct("d", "tag")).alias("first"))
    counted = common.materialize(counted.where(F.col("docs") >= min_docs).select("template", "first"), "counted")
    drop = of.join(common.small_or_shuffled(counted), "template").where(F.struct("d", "tag") != F.col("first"))
    return drop.groupBy("d", "tag").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def _without(lines: Column, dropped: Column) -> Column:
    """``lines`` but for the numbers in ``dropped`` (sorted): the slices between them, so one pass over either."""
    cut = F.transform(F.array(F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))), lambda c: F.transform(
        F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.slice(lines, F.get(c, i - 1) + 2, F.get(c, i) - F.get(c, i - 1) - 1)
    ))
    return F.flatten(cut[0])


def dedup_lines(docs: DataFrame, min_docs: int = 5, depth: int = 3, similarity: float = 0.75) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` per row of ``docs(doc_id, text)``, ``text`` without recurring lines.

    A template recurs if ``min_docs`` documents or more have an instance of it; the document of the smallest doc_id
    (null first) keeps its instances, every other loses them. Support of a token counts the pairs of a document and
    a different masked line of it. Lines end at ``\\n``; lines without a token stay. Null text is one empty line; rows
    equal in doc_id and text are one document and each returned; rows with one doc_id but different texts are
    documents of their own. Other columns are ignored; an empty table gives no rows.
    """
    joined = _keyed(docs).join(recurring(docs, min_docs, depth, similarity), ["d", "tag"], "left")
    lines = F.split("text", "\n")
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(_without(F.col("lines"), F.col("dropped")), "\n"))
    return joined.withColumn("lines", lines).select(
        "doc_id", F.size("lines").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"), kept.alias("text")
    )


def without_recurring_lines(docs: DataFrame, min_docs: int = 5, depth: int = 3, similarity: float = 0.75) -> DataFrame:
    """``docs`` with all its columns, whatever their names, ``text`` (and ``n_chars``, where there is one) after ``dedup_lines``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("tag"), F.split(text, "\n").alias("lines"), common.packed(docs))
    joined = named.join(recurring(docs, min_docs, depth, similarity), ["d", "tag"], "left")
    kept = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(F.array_join(_without(F.col("lines"), F.col("dropped")), "\n"))
    parts = joined.select("row", "dropped", kept.alias("kept"))
    changed = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("dropped").isNull(), F.col("row.n_chars")).otherwise(F.length("kept").cast("long"))
    return parts.select(*common.unpacked(docs, **changed))
