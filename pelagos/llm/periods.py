"""Periodic runs of words in documents: stretches that repeat a block of words over and over.

A run is a stretch of words with smallest period q (words q apart are identical), of max(LEAST, TIMES * q) words at
least, that no neighbouring word extends. Documents are taken in Arrow batches as they lie in the input; nothing is
shuffled, and all documents of a piece of a batch are worked on at once:

1. Masking. In a run of length L every word lies in a k-gram that the document holds twice, q words apart, for every
   k up to L - q. The least L - q over all q is k; words outside repeated k-grams can be in no run. k-grams meet by
   hash here, which can keep a word too many and never one too few.
2. Main-Lorentz, on the segments that survive only: halves around a middle, whose two sides are extended for every
   period. The levels of the recursion are done one after the other, all nodes of all segments together; common
   extensions come from exact names of the blocks of 2^j words. An extension is not cut at the node's bounds, so that
   what is found is maximal at once.

Null texts and texts without a word have no run; a row whose doc_id is null is a document like any other. Repeated
rows give repeated results. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the shortest run, and periods of it.
LEAST, TIMES = 6, 4
#: Words worked on at once; a longer document is a piece of its own.
PIECE = 300_000


def overlap(least: int = LEAST, times: int = TIMES) -> int:
    """The least length minus period of a run: what two copies of it, moved by a period, have in common."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def words(text: str | None) -> list[bytes]:
    """Maximal runs of anything but the ASCII white space characters, as UTF-8."""
    return (text or "").encode().split()


def repeated_grams(ids: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that their document holds twice; a few others may be among them."""
    n = len(ids) - k + 1
    if n < 2:
        return np.zeros(len(ids), bool)
    h = doc[:n].astype(np.uint64)
    for j in range(k):
        h = (h ^ ids[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    whole = doc[:n] == doc[k - 1 :]
    order = np.sort(h[whole])
    again = np.unique(order[1:][order[1:] == order[:-1]])
    at = np.flatnonzero(whole)
    if len(again):
        place = np.minimum(np.searchsorted(again, h[at]), len(again) - 1)
        at = at[again[place] == h[at]]
    else:
        at = at[:0]
    depth = np.zeros(len(ids) + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + k, -1)
    return np.cumsum(depth[:-1]) > 0


def segments(kept: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of ``kept`` words of one document, those of ``least`` words or more."""
    edge = np.flatnonzero(np.concatenate(([True], (kept[1:] != kept[:-1]) | (doc[1:] != doc[:-1]), [True]))) if len(kept) else np.zeros(0, np.int64)
    start, end = edge[:-1], edge[1:]
    use = kept[start] & (end - start >= least)
    return start[use], end[use]


def block_names(w: np.ndarray, longest: int) -> list[np.ndarray]:
    """For every j with 2^j up to ``longest`` the names of the blocks of 2^j words at each place: equal names, equal
    blocks. A block that would run over the end has a name of its own."""
    names = [np.unique(w, return_inverse=True)[1].astype(np.int64)]
    n, size = len(w), 1
    while 2 * size <= longest:
        last = names[-1]
        pair = last[: n - size] * (int(last.max()) + 1) + last[size:]
        found, own = np.unique(pair, return_inverse=True)
        names.append(np.concatenate((own, len(found) + np.arange(n - len(own)))))
        size *= 2
    return [x.astype(np.int32) for x in names]


def common_after(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from ``i`` on equal those from ``j`` on (i < j)."""
    out = np.zeros(len(i), np.int64)
    n = len(names[0])
    for level in range(len(names) - 1, -1, -1):
        a, b = i + out, j + out
        inside = b + (1 << level) <= n
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        out += np.where(inside & (names[level][a] == names[level][b]), 1 << level, 0)
    return out


def common_before(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before ``i`` equal those before ``j`` (i < j), going backwards."""
    out = np.zeros(len(i), np.int64)
    for level in range(len(names) - 1, -1, -1):
        a, b = i - out - (1 << level), j - out - (1 << level)
        inside = a >= 0
        a, b = np.maximum(a, 0), np.maximum(b, 0)
        out += np.where(inside & (names[level][a] == names[level][b]), 1 << level, 0)
    return out


def main_lorentz(w: np.ndarray, start: np.ndarray, end: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of all runs inside the segments ``[start, end)`` of ``w``, by start and period.

    Between two segments lies a word that is equal to no other.
    """
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none
    names = block_names(w, int((end - start).max()))
    found = []
    lo, hi = start, end
    while len(lo):
        mid = (lo + hi) // 2
        most = (hi - lo) // times
        at = np.repeat(mid, most)
        q = np.arange(len(at)) - np.repeat(np.cumsum(most) - most, most) + 1
        for left in (at, at - q):  # a run over the middle has a whole period to its right, or else to its left
            fits = left >= 0
            a, p = left[fits], q[fits]
            s, e = a - common_before(names, a, a + p), a + p + common_after(names, a, a + p)
            runs = e - s >= np.maximum(least, times * p)
            found.append((s[runs], e[runs], p[runs]))
        lo, hi = np.concatenate((lo, mid)), np.concatenate((mid, hi))
        wide = hi - lo >= least
        lo, hi = lo[wide], hi[wide]
    s, e, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    first = np.concatenate(([True], (s[1:] != s[:-1]) | (e[1:] != e[:-1]))) if len(s) else np.zeros(0, bool)  # multiples of a period have the stretch of it
    s, e, q = s[first], e[first], q[first]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def runs_of(ids: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of all documents of ``ids``, whose words have the document's number in ``doc``; places are those in ``ids``."""
    kept = repeated_grams(ids, doc, overlap(least, times))
    start, end = segments(kept, doc, least)
    size = end - start + 1  # one more for the word between
    shift = start - (np.cumsum(size) - size)
    inside = np.arange(int(size.sum())) + np.repeat(shift, size)
    apart = np.cumsum(size) - 1
    w = ids[np.minimum(inside, len(ids) - 1)] if len(ids) else ids
    w[apart] = -1 - np.arange(len(apart))
    s, e, q = main_lorentz(w, start - shift, end - shift, least, times)
    back = shift[np.searchsorted(apart, s)] if len(s) else s
    return s + back, e + back, q


def find(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> Iterator[list[tuple[int, int, int]]]:
    """For every document, given as its words, its runs as (start, length, period), by start and period."""
    number = defaultdict(count().__next__)
    sizes = [len(t) for t in texts]
    ids = np.fromiter((number[w] for t in texts for w in t), np.int64, sum(sizes))
    doc = np.repeat(np.arange(len(texts)), sizes)
    s, e, q = runs_of(ids, doc, least, times)
    first = np.cumsum([0, *sizes])
    cut = np.searchsorted(s, first)
    for i, at in enumerate(first[:-1]):
        a, b = cut[i], cut[i + 1]
        yield list(zip((s[a:b] - at).tolist(), (e[a:b] - s[a:b]).tolist(), q[a:b].tolist(), strict=True))


def collapsed(text: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words left if every run keeps its first period only."""
    if not runs:
        return text
    gone = np.zeros(len(text) + 1, np.int64)
    for s, n, q in runs:
        gone[s + q] += 1
        gone[s + n] -= 1
    left = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return [text[i] for i in left]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length over period; of equal ones the first, then that of the smallest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def map_documents(docs: DataFrame, result, schema: str, changed=None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``result(words, runs)`` for every row of ``docs(doc_id, text)`` beside its doc_id. ``changed(doc_id, words)`` gives
    the words that a document is to be judged by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            texts = batch.column("text")
            rows, held, some = [], 0, []

            def judged(some: list) -> list:
                return [result(t, r) for t, r in zip(some, find(some, least, times), strict=True)]

            for i, key in enumerate(ids):
                own = words(texts[i].as_py())
                own = changed(key, own) if changed else own
                if some and held + len(own) > PIECE:
                    rows += judged(some)
                    some, held = [], 0
                some.append(own)
                held += len(own)
            rows += judged(some)
            out = [pa.array(ids, pa.string())] + [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(out, names=names)

    fields = [f.split() for f in schema.split(", ")]
    names = ["doc_id", *[f[0] for f in fields]]
    kinds = [{"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}[f[1]] for f in fields]
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInArrow(run, f"doc_id string, {schema}")
    return rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``(doc_id, start, length, period, text)`` of every document: its runs as three lists by start and period, and its
    words without what the runs repeat, joined by blanks."""

    def result(text: list[bytes], found: list) -> tuple:
        return *[[r[c] for r in found] for c in range(3)], b" ".join(collapsed(text, found)).decode()

    return map_documents(docs, result, "start array<long>, length array<long>, period array<long>, text string", None, least, times)
