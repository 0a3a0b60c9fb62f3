"""Exact removal of repeated byte strings with suffix arrays, whatever documents they lie in.

Every 100-byte string of a text has a minimizer, the smallest hash of its 32-byte substrings; equal strings
have equal minimizers. Neighbouring strings with one minimizer form a segment, and segments are dealt out by
minimizer, so equal strings meet wherever they come from while the text is moved only once per join:

1. Segments are described (not carried) by minimizer, content hash and place. Equal segments of one batch are
   reduced to the earliest before the shuffle; a minimizer with very many different segments in a batch is
   marked hot there, and its segments are dealt out by content instead. Equal means minimizer and content hash
   alike, 128 bits together.
2. Where a minimizer's segments meet, a segment that is equal to an earlier one is removed whole. Minimizers
   with one occurrence are dropped. What is left are different segments with a common minimizer.
3. Their texts are sorted as suffix arrays in bounded blocks (two-stage sorting), and strings equal to an
   earlier neighbour by common prefix are removed. The segments of hot minimizers, and of those with very many
   different ones, are cut into single strings first, dealt out by hash and compared byte by byte in the blocks.
4. The removed spans of each document are joined back to its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_digest, xxh3_64_intdigest

from pelagos.llm import common

#: Bytes of the substrings whose hashes choose a string's minimizer.
GRAM = 32
#: Most strings of one segment.
RUN = 256
#: Different segments of one minimizer in one batch from which on it is hot.
HOT = 64
#: Different segments of one minimizer altogether from which on they are spread as strings, so that a block is bounded.
WIDE = 4096
#: Described segments of one minimizer that are held at once.
MOST = 200_000
#: Bytes of text that are sorted at once.
BLOCK = 2_000_000

ONCE, REMOVED, SPREAD, MARK, INNER = 0, 1, 2, 3, 4
PLACE = "d long, tag long, start int, n int"


# ---- suffix sorting -------------------------------------------------------------------------------


def _words(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from ``at + depth`` on as one number that sorts like them."""
    padded = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    return padded[np.minimum(at + depth, len(padded) - 1)].astype(np.uint64)


def _sort_direct(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the suffixes there, compared to ``depth`` bytes at least; eight bytes a round, ties only."""
    order = at[np.argsort(_words(text, at, 0), kind="stable")]
    word = _words(text, order, 0)
    group = np.concatenate(([0], np.cumsum(word[1:] != word[:-1])))
    for d in range(8, depth, 8):
        tied = np.concatenate(([False], group[1:] == group[:-1]))
        tied[:-1] |= tied[1:]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        word = _words(text, order[where], d)
        inner = np.lexsort((word, group[where]))
        order[where] = order[where][inner]
        word = word[inner]
        new = np.zeros(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        new[where[1:]] |= word[1:] != word[:-1]
        new[0] = False
        group = np.cumsum(new)
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` in the order of their suffixes, to ``depth`` bytes at least (ties in any order).

    ``text`` holds bytes of at least 1 and single zeros that end the segments; the last byte is a zero, eight
    more zeros follow outside the result. Two stages: only suffixes smaller than their successors are sorted
    directly; scanning the buckets of first bytes in order places every other suffix behind its successor.
    """
    n = len(text) - 8
    body = text[:n]
    # A suffix is smaller than its successor if the next different byte is larger; zeros count as smaller.
    change = np.flatnonzero(body[1:] != body[:-1])
    following = np.searchsorted(change, np.arange(n))
    smaller = np.ones(n, bool)
    inside = following < len(change)
    smaller[inside] = body[change[following[inside]] + 1] > body[change[following[inside]]]
    smaller |= body == 0
    sizes = np.bincount(body, minlength=256)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    out = np.full(n, -1, np.int64)
    ends_of_text = np.flatnonzero(body == 0)
    out[: len(ends_of_text)] = ends_of_text
    direct = _sort_direct(text, np.flatnonzero(smaller & (body > 0)), depth)
    first = body[direct]
    for c, (lo, hi) in enumerate(zip(np.searchsorted(first, np.arange(256)), np.searchsorted(first, np.arange(256), side="right"), strict=True)):
        out[ends[c] - (hi - lo) : ends[c]] = direct[lo:hi] if hi > lo else direct[:0]
    fill = heads.copy()
    for c in np.flatnonzero(sizes).tolist():
        done = heads[c]
        while c and done < fill[c]:
            previous = out[done : fill[c]] - 1
            done = fill[c]
            previous = previous[previous >= 0]
            previous = previous[body[previous] == c]
            out[fill[c] : fill[c] + len(previous)] = previous
            fill[c] += len(previous)
        previous = out[heads[c] : ends[c]] - 1
        previous = previous[previous >= 0]
        previous = previous[body[previous] > c]
        byte = body[previous]
        previous = previous[np.argsort(byte, kind="stable")]
        counts = np.bincount(byte, minlength=256)
        starts = np.cumsum(counts) - counts
        for x in np.flatnonzero(counts).tolist():
            out[fill[x] : fill[x] + counts[x]] = previous[starts[x] : starts[x] + counts[x]]
            fill[x] += counts[x]
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix of ``order`` shares with the one before it, counted to ``depth``; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for d in range(0, depth, 8):
        differ = _words(text, order[live], d) ^ _words(text, order[live - 1], d)
        same = np.full(len(live), 8)
        some = differ != 0
        same[some] = (63 - np.floor(np.log2(differ[some].astype(np.float64))).astype(np.int64)) // 8
        out[live] += same
        live = live[~some]
    return np.minimum(out, depth)


def repeated(segments: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """``(segment, from, to)``: runs of starts of ``length``-byte strings that also start earlier, in an earlier
    segment or further left in the same one."""
    text = np.frombuffer(b"\0".join(x.translate(UP) for x in segments) + bytes(9 + length), np.uint8).copy()
    text = text[: len(text) - length]
    order = suffix_array(text, length)
    lengths = np.array([len(x) for x in segments], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    owner = np.searchsorted(starts, order, side="right") - 1
    whole = order + length <= starts[owner] + lengths[owner]
    equal = common_prefixes(text, order, length) >= length
    group = np.cumsum(~equal)
    order, group = order[whole], group[whole]
    by = np.lexsort((order, group))
    order, group = order[by], group[by]
    again = np.sort(order[1:][group[1:] == group[:-1]])
    if not len(again):
        return []
    owner = np.searchsorted(starts, again, side="right") - 1
    cut = np.flatnonzero((np.diff(again) != 1) | (np.diff(owner) != 0)) + 1
    lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [len(again)]))
    return [(int(owner[i]), int(again[i] - starts[owner[i]]), int(again[j - 1] - starts[owner[i]]) + 1) for i, j in zip(lo, hi, strict=True)]


#: Bytes one up, so that zero can end segments; 255 does not occur in UTF-8.
UP = bytes(min(i + 1, 255) for i in range(256))


# ---- segments -------------------------------------------------------------------------------------


def segments_of(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first string, strings, whether its minimizer lies in it twice) of the segments of ``data``, left to
    right; none if it is too short. Only a segment with its minimizer at two places can hold one string twice."""
    n = len(data) - length + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    grams = len(data) - GRAM + 1
    h = words[:grams] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h += words[i : i + grams]
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    gram, width, span = h, length - GRAM + 1, 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    low = np.minimum(h[:n], h[width - span : width - span + n]) if width > span else h[:n]
    cuts = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1, [n]))
    size = np.diff(cuts)
    if size.max() > RUN:
        parts = -(-size // RUN)
        first = np.repeat(cuts[:-1], parts) + RUN * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        cuts = np.concatenate((first, [n]))
        size = np.diff(cuts)
    at, key = cuts[:-1], low[cuts[:-1]]
    seen = np.lib.stride_tricks.sliding_window_view(gram, width)
    head, tail = seen[at] == key[:, None], seen[at + size - 1] == key[:, None]
    twice = (head.sum(axis=1) + tail.sum(axis=1) != 2) | (head.argmax(axis=1) != size - 1 + tail.argmax(axis=1))
    return key.view(np.int64), at, size, twice & (size > 1)


def _describe(length: int):
    """mapInArrow body: documents ``(d, tag, text)`` to described segments, combined within each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts = []
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_py()
                key, start, size, twice = segments_of(data, length)
                if len(key):
                    content = np.fromiter((xxh3_64_intdigest(data[a : a + m + length - 1]) for a, m in zip(start.tolist(), size.tolist(), strict=True)), np.uint64, len(key))
                    parts.append((np.full(len(key), i), key, content.view(np.int64), start, size, twice))
            if not parts:
                continue
            row, key, content, start, size, twice = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((start, tag[row], d[row], content, key))
            row, key, content, start, size, twice = (x[order] for x in (row, key, content, start, size, twice))
            new_key = np.concatenate(([True], key[1:] != key[:-1]))
            new = new_key | np.concatenate(([True], content[1:] != content[:-1]))
            # Rows that repeat one document entirely stand at the same place as the first.
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            new |= (d[row] == d[row[first]]) & (tag[row] == tag[row[first]]) & (start == start[first])
            group = np.cumsum(new_key) - 1
            hot = np.bincount(group, weights=new)[group] > HOT
            kind = np.where(new, np.where(hot, SPREAD, np.where(twice, INNER, ONCE)), REMOVED)
            p = np.where((kind == ONCE) | (kind == INNER), key, content ^ (d[row] * np.int64(1000003) + start))
            marks = np.flatnonzero(new_key & hot)
            take = np.concatenate((np.arange(len(key)), marks))
            kind = np.concatenate((kind, np.full(len(marks), MARK)))
            p = np.concatenate((p, key[marks]))
            yield pa.record_batch(
                [pa.array(p), pa.array(kind.astype(np.int32)), pa.array(key[take]), pa.array(content[take]), pa.array(d[row[take]]), pa.array(tag[row[take]]), pa.array(start[take].astype(np.int32)), pa.array(size[take].astype(np.int32))],
                ["p", "kind", "key", "content", "d", "tag", "start", "n"],
            )

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: described segments sorted by ``p``, marks first, then content and place; gives REMOVED, ONCE and
    SPREAD rows that matter. A minimizer beyond ``MOST`` rows is settled a part at a time, its segments to be spread."""

    def settle(cols: list[np.ndarray], forced: bool, known: int) -> pa.RecordBatch:
        """``known`` first rows were given out before and are there to compare with."""
        p, kind, key, content, d, tag, start, n = cols
        plain = np.flatnonzero((kind != REMOVED) & (kind != SPREAD))
        order = plain if known else plain[np.lexsort((start[plain], tag[plain], d[plain], content[plain], kind[plain] != MARK, key[plain]))]
        k, c = key[order], content[order]
        new_key = np.concatenate(([True], k[1:] != k[:-1]))[: len(k)]
        group = np.cumsum(new_key) - 1
        segment = kind[order] != MARK
        marked = (np.bincount(group, weights=~segment) > 0)[group] | forced if len(k) else np.zeros(0, bool)
        order, group, marked, k, c = order[segment], group[segment], marked[segment], k[segment], c[segment]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])))[: len(k)]
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, int)
        same = (d[order] == d[order[first]]) & (tag[order] == tag[order[first]]) & (start[order] == start[order[first]])
        count = np.bincount(group, weights=new)[group] if len(k) else np.zeros(0)
        marked |= count > WIDE
        given, needed = np.flatnonzero((kind == REMOVED) | (kind == SPREAD)), new & ((count > 1) | marked | (kind[order] == INNER))
        needed &= order >= known
        out = np.concatenate((given, order[~same], order[needed]))
        what = np.concatenate((kind[given], np.full((~same).sum(), REMOVED), np.where(marked, SPREAD, ONCE)[needed]))
        return pa.record_batch([pa.array(what.astype(np.int32)), *(pa.array(x[out]) for x in (key, d, tag, start, n))], ["kind", "key", "d", "tag", "start", "n"])

    def earliest(rows: list[np.ndarray]) -> list[np.ndarray]:
        """The first row of the last content, to compare what follows with."""
        same = np.flatnonzero(rows[3] == rows[3][-1])
        return [x[same[:1]] for x in rows]

    held: list[list[np.ndarray]] = []
    forced, known, count = False, 0, 0
    for batch in batches:
        rows = [batch.column(i).to_numpy() for i in range(8)]
        if not len(rows[0]):
            continue
        if held and (rows[0][0] != held[0][0][0] or rows[0][-1] != held[0][0][0] or count + len(rows[0]) > MOST):
            cut = int(np.searchsorted(rows[0], held[0][0][0], side="right")) if rows[0][0] == held[0][0][0] else 0
            whole = [np.concatenate(x) for x in zip(*held, [x[:cut] for x in rows], strict=True)]
            forced |= cut == len(rows[0])
            yield settle(whole, forced, known)
            if cut == len(rows[0]):
                held, known = [earliest(whole)], 1
                count = 1
                continue
            rows, held, forced, known, count = [x[cut:] for x in rows], [], False, 0, 0
        if not held:
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:
                yield settle([x[:cut] for x in rows], False, 0)
                rows = [x[cut:] for x in rows]
        held.append(rows)
        count += len(rows[0])
    if held:
        yield settle([np.concatenate(x) for x in zip(*held, strict=True)], forced, known)


def _fetch(length: int):
    """mapInArrow body: texts with their wanted segments ``(kind, key, start, n)`` to segments with text; the strings of
    minimizers to be spread become segments of their own, dealt out by their hash. Of equal strings of one batch the
    earliest goes on, the rest are removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            strings: dict[bytes, tuple] = {}
            for d, tag, data, wanted in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for w in wanted:
                    start, n = w["start"], w["n"]
                    if w["kind"] == ONCE:
                        rows.append((ONCE, w["key"], d, tag, start, n, data[start : start + n + length - 1]))
                        continue
                    for s in range(start, start + n):
                        string, place = data[s : s + length], (d, tag, s)
                        old = strings.get(string, place)
                        strings[string] = min(old, place)
                        if old != place:
                            rows.append((REMOVED, hash(place), *max(old, place), 1, b""))
            rows += [(ONCE, int.from_bytes(xxh3_64_digest(x), "little", signed=True), *place, 1, x) for x, place in strings.items()]
            if rows:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "key", "d", "tag", "start", "n", "data"])

    return run


def _sort_blocks(length: int):
    """mapInArrow body: fetched segments sorted by key; gives the removed runs of strings.

    Equal bytes are one entry of a block; the different ones are sorted as one suffix array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        block: dict[bytes, tuple] = {}
        size = 0

        def flush() -> None:
            nonlocal block, size
            items = sorted(block.items(), key=lambda x: x[1])
            for i, a, b in repeated([x for x, _ in items], length) if len(items) else []:
                d, tag, start = items[i][1]
                out.append((d, tag, start + a, b - a))
            block, size = {}, 0

        last = None
        for batch in batches:
            for kind, key, d, tag, start, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == REMOVED:
                    out.append((d, tag, start, n))
                    continue
                if key != last and size > BLOCK:
                    flush()
                last = key
                old = block.get(data)
                if old is None:
                    block[data] = (d, tag, start)
                    size += len(data)
                elif old != (d, tag, start):
                    block[data] = min(old, (d, tag, start))
                    out.append((*max(old, (d, tag, start)), n))
            if len(out) > 50_000:
                yield _places(out)
                out.clear()
        flush()
        if out:
            yield _places(out)

    return run


def _places(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["d", "tag", "start", "n"])


def _remove(length: int):
    """mapInArrow body: ``(doc_id, data, starts, ns)`` to the result rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, at, removed, count = [], 0, 0, 0
                end = -1
                for a, n in sorted((s["start"], s["n"]) for s in spans or []):
                    b = a + n + length - 1
                    if a > end:
                        count += 1
                        kept.append(data[at:a])
                        removed += b - a
                    elif b > end:
                        removed += b - end
                    end = max(end, b)
                    at = end
                kept.append(data[at:])
                rows.append((len(data), removed, count, b"".join(kept)))
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            ) if rows else pa.record_batch([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` per row of ``docs(doc_id, text)``; texts as UTF-8, null as empty.

    Each byte under a ``length``-byte string that also starts earlier (smaller doc_id, or further left in the same
    document) goes; null doc_ids come first. Rows with one doc_id but different texts are documents of their own, in
    the order of a hash of their texts; rows equal in both are one document and keep the same bytes. Texts shorter
    than ``length`` are kept whole; other columns are ignored; an empty table gives no rows.
    """
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data")).select(
        "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("data").alias("tag"), "data"
    )
    described = base.select("d", "tag", "data").mapInArrow(_describe(length), f"p long, kind int, key long, content long, {PLACE}")
    met = common.materialize(
        common.tuned(described, ["p"]).sortWithinPartitions("p", F.col("kind") != MARK, "content", "d", "tag", "start").mapInArrow(_meet, f"kind int, key long, {PLACE}"), "met"
    )
    texts = common.tuned(base, ["d", "tag"])
    wanted = met.where(F.col("kind") != REMOVED).groupBy("d", "tag").agg(F.collect_list(F.struct("kind", "key", "start", "n")).alias("wanted"))
    fetched = (
        texts.join(wanted, ["d", "tag"]).select("d", "tag", "data", "wanted", "doc_id")
        .mapInArrow(_fetch(length), f"kind int, key long, {PLACE}, data binary")
    )
    sorted_out = common.tuned(fetched, ["key"]).sortWithinPartitions("key", "kind", "data", "d", "tag", "start").mapInArrow(_sort_blocks(length), PLACE)
    spans = met.where(F.col("kind") == REMOVED).select("d", "tag", "start", "n").unionByName(sorted_out)
    by_doc = spans.groupBy("d", "tag").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = texts.join(by_doc, ["d", "tag"], "left").select("doc_id", "data", "spans")
    return joined.mapInArrow(_remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
