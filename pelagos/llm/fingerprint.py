"""Document fingerprints: SimHash of weighted terms, compared with edited texts and searched through block tables."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pelagos.llm import common, simhash

#: Seed of the term hashes.
SEED = 8
#: Terms whose bits are weighed at once.
CHUNK = 1 << 15


def fingerprint(text: str) -> int:
    """64 bits, each the sign of the votes of the term hashes.

    Terms are runs of three words (of fewer where the text has fewer) with A-Z lowered; a term's weight is
    1 + ln(times it occurs), so a repeated term counts without drowning the rest. No term: zero.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(3, len(words))
    terms = Counter(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    hashes = np.fromiter((xxh64_intdigest(t, SEED) for t in terms), "<u8", len(terms))
    weights = 1 + np.log(np.fromiter(terms.values(), np.float64, len(terms)))
    votes = np.zeros(64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += weights[i : i + CHUNK] @ bits
    return int.from_bytes(np.packbits(2 * votes > weights.sum(), bitorder="little").tobytes(), "little")


def likeness(a: int, b: int) -> float:
    """The cosine that the share of differing bits estimates, 0 for unrelated fingerprints, 1 for equal ones."""
    return max(0.0, float(np.cos(np.pi * (a ^ b).bit_count() / 64))) if a != b else 1.0


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points (rounded down) replaced by the first as many of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: rows ``(bucket, own, doc_id, text)`` in order; each own row with the row after it."""
    held = None
    for batch in batches:
        rows = []
        for bucket, own, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fp = fingerprint(text)
            if held and held[0] == bucket and held[1]:
                rows.append(_digest(*held[2:], text, fp))
            held = (bucket, own, doc_id, text, fp)
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            names = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _digest(doc_id, text: str, fp: int, following: str, next_fp: int) -> tuple:
    changed = edited(text, following)
    other = fingerprint(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, simhash._signed(fp), simhash._signed(other), likeness(fp, other), likeness(fp, next_fp)


def against_edits(docs: DataFrame, per_partition: int = 4) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with its fingerprint, its edited text's and the next document's likeness.

    Returns ``doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next``. The next document is that of
    the next doc_id, nulls first, rows of one doc_id in the order of their texts; the first follows the last. Null
    text is empty; a single row follows itself; other columns are ignored; an empty table gives no rows.

    Rows are dealt by doc_id into ranges of about equal counts, from quantiles of the ids alone, and the first row
    of each range is sent to the range before it too: texts move once and nothing is sorted in one place.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = n * per_partition
    cuts = base.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.coalesce(F.array_size(F.filter(F.lit(cuts), lambda x: x <= F.col("doc_id"))), F.lit(0)) if cuts else F.lit(0)
    dealt = base.withColumn("bucket", bucket.cast("int"))
    firsts = sorted(
        (r["bucket"], r["nulls"], r["low"])
        for r in dealt.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls")).collect()
    )
    low, before = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for i, (own, _, first) in enumerate(firsts):
        low[own], before[own] = first or 0, firsts[i - 1][0]
    nulls_first = bool(firsts and firsts[0][1])
    is_null = F.col("doc_id").isNull()
    is_first = (F.col("doc_id") == F.get(F.lit(low), F.col("bucket"))) & ~(F.lit(nulls_first) & (F.col("bucket") == 0)) | (is_null & F.lit(nulls_first))
    also = F.when(F.coalesce(is_first, is_null), F.struct(F.get(F.lit(before), F.col("bucket")).alias("bucket"), F.lit(False).alias("own")))
    place = F.struct(F.col("bucket"), F.lit(True).alias("own"))
    sent = dealt.select("doc_id", "text", F.explode(F.array_compact(F.array(place, also))).alias("at")).select("at.bucket", "at.own", "doc_id", "text")
    sorted_rows = common.tuned(sent, ["bucket"]).sortWithinPartitions("bucket", F.desc("own"), F.col("doc_id").asc_nulls_first(), "text")
    return sorted_rows.mapInArrow(
        _compare, "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, near_next double"
    )


def search(queries: DataFrame, points: DataFrame, radius: int = 3) -> DataFrame:
    """``(q, fp, bits)``: every fingerprint of ``points(fp)`` at ``radius`` or fewer bits from one of ``queries(q)``.

    Both sides hold each fingerprint once. Tables of permuted blocks: two fingerprints within the radius agree on
    at least one choice of blocks, so each table joins on the bits of its choice; a pair is kept in the first table
    it meets in only, so none comes twice. More, narrower blocks are taken as the points grow.
    """
    masks = [simhash._signed(m) for m in simhash.block_masks(radius, simhash.blocks_for(points.count(), radius))]
    keys = lambda x: F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col(x).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    left = queries.select("q", keys("q").alias("k")).select("q", "k.t", "k.key")
    right = points.select("fp", keys("fp").alias("k")).select("fp", "k.t", "k.key")
    differ = F.col("q").bitwiseXOR(F.col("fp"))
    agree = F.array(*[differ.bitwiseAND(F.lit(m)) == 0 for m in masks])
    met = left.join(right, ["t", "key"])
    return met.where((F.bit_count(differ) <= radius) & (F.array_position(agree, True) == F.col("t") + 1)).select("q", "fp", F.bit_count(differ).alias("bits"))


def near_counts(prints: DataFrame, radius: int = 3, every: int = 100) -> DataFrame:
    """``(fp, n_near)`` for the fingerprints of the stated query rows (doc_id divisible by ``every``): rows of
    ``prints(doc_id, fp)`` at ``radius`` or fewer bits, the row itself included."""
    points = common.materialize(prints.groupBy("fp").agg(F.count("*").alias("rows")), "prints")
    queries = prints.where(F.col("doc_id") % every == 0).select(F.col("fp").alias("q")).distinct()
    found = search(queries, points.select("fp"), radius).join(points, "fp")
    return found.groupBy("q").agg(F.sum("rows").alias("n_near")).withColumnRenamed("q", "fp")
