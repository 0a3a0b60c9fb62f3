"""Best-fit packing by minimum bin slack over the histogram of piece lengths.

Only how many pieces there are of each length matters to a packing, and there are at most ``capacity``
lengths however large the corpus is. The driver plans on that bounded histogram: each bin starts with the
longest length left, bitset subset-sum dynamic programming over the lengths available finds the fullest
feasible combination, and it is removed as often as the counts allow. Executors then number the pieces of
each length and look their places up in the plan.
"""

from __future__ import annotations

import re
import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pelagos.llm import common

#: Tokenizer results kept per Python worker, about 200 bytes each.
CACHE = 300_000
#: Longest chunk that is kept, in characters.
KEPT = 64
#: Bytes of text whose chunks are told apart together.
TOGETHER = 8 << 20
#: Words that the tokenizer's normalizer only lowers and its pre-tokenizer leaves whole.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Marks that end a chunk; the tokenizer never joins them to the letter before.
MARKS = string.punctuation
#: The vocabulary writes each byte as a letter: those without a visible form of their own are numbered from 256 on.
HIDDEN = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}


class ChunkIds(dict):
    """Token ids (little-endian 32-bit bytes) of chunks of text, computed once each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def __missing__(self, chunk: str) -> bytes:
        """A word goes straight to the tokenizer's model, since most of the time of the whole tokenizer is spent before
        it; marks at its end are looked up apart. All other chunks take the whole way."""
        word = chunk.rstrip(MARKS)
        if not LETTERS.fullmatch(word):
            found = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        elif len(word) < len(chunk):
            return self[word] + self[chunk[len(word) :]]
        else:
            word = word.lower()
            found = [t.id for t in self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(HIDDEN))]
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(chunk) <= KEPT:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = ids
        return ids

    def of_texts(self, texts: pa.Array) -> pa.Array:
        """Ids of whole texts, null ones empty. The tokenizer lowers case, drops white space and never joins across it, so
        chunks are looked up with A-Z lowered, each once for all the texts; a text that may hold special tokens keeps its case."""
        texts = texts.fill_null("")
        chunks = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        told = chunks.flatten().dictionary_encode()
        ids = pa.array(map(self.__getitem__, told.dictionary.to_pylist()), pa.large_binary()).take(told.indices)
        return pc.binary_join(pa.ListArray.from_arrays(chunks.offsets, ids), pa.scalar(b"", pa.large_binary()))

    def of(self, text: str) -> bytes:
        """Ids of a whole text."""
        return self.of_texts(pa.array([text]))[0].as_py()


@lru_cache(maxsize=2)
def _chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def slices(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """Consecutive rows, first and end, of less than ``most`` bytes of text besides their first row's."""
    shelf = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64) // most
    return list(pairwise([0, *(np.flatnonzero(np.diff(shelf)) + 1).tolist(), len(texts)]))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every row of ``docs(doc_id, text)``.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its chunks in turn;
    id 0 ends each document. Null and empty texts are that one id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _chunk_ids(tokenizer)
        width = 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column(1)
            for first, end in slices(texts, TOGETHER):
                found = known.of_texts(texts[first:end])
                for doc_id, own in zip(batch.column(0)[first:end].to_pylist(), found, strict=True):
                    ids = own.as_py() + bytes(4)
                    for k, at in enumerate(range(0, len(ids), width)):
                        part = ids[at : at + width]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum not above ``room``, as length -> how many.

    Bit s of ``reach`` says whether the lengths seen so far can sum to s; longest lengths come first, so among
    equal sums the one of the longest pieces is taken.
    """
    limit = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left > 0:
            size = min(size, left)
            steps.append((length, size, reach))
            reach |= (reach << (length * size)) & limit
            left -= size
            size *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    out: dict[int, int] = {}
    for length, size, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + size
            total -= length * size
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bins as (length -> how many, number of such bins), each the fullest around the longest piece left."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    bins = []
    while counts:
        first = max(counts)
        counts[first] -= 1
        if not counts[first]:
            del counts[first]
        chosen = fullest(counts, capacity - first)
        counts[first] = counts.get(first, 0) + 1
        chosen[first] = chosen.get(first, 0) + 1
        times = min(counts[n] // k for n, k in chosen.items())
        bins.append((chosen, times))
        for n, k in chosen.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return bins


def lookup(bins: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> arrays (first rank, pieces per bin, first sequence, first offset), one entry per bin shape that uses it."""
    table: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for chosen, times in bins:
        offset = 0
        for length, k in sorted(chosen.items(), reverse=True):
            table.setdefault(length, []).append((used.get(length, 0), k, sequence, offset))
            used[length] = used.get(length, 0) + k * times
            offset += length * k
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in table.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, per_group: int = 100_000) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; see ``pieces`` for the other columns.

    Pieces of one length are numbered in groups of about ``per_group``, so a length that very many pieces share
    is numbered in many tasks. Repeated rows are packed as often as they come; other columns are ignored; an
    empty table gives no rows.
    """
    cut = common.materialize(pieces(docs, tokenizer, capacity), "pieces")
    groups = 1 + cut.count() // per_group
    grouped = cut.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    sizes = common.materialize(grouped.groupBy("length", "grp").count(), "lengths")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = lookup(plan(histogram, capacity))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("grp").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")
    numbered = grouped.withColumn("own", F.row_number().over(Window.partitionBy("length", "grp").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = numbered.join(sizes.select("length", "grp", before.alias("before")), ["length", "grp"]).select(
        *cut.columns, (F.col("own") + F.col("before")).alias("rank")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, k, base, place = places[int(n)]
                i = np.searchsorted(first, rank[at], side="right") - 1
                copy, slot = np.divmod(rank[at] - first[i], k[i])
                sequence[at], offset[at] = base[i] + copy, place[i] + slot * n
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
