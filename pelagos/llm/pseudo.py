"""Language-model scores by masked pseudo-likelihood.

A network predicts every token of a text from the two tokens before and the two after it; the sum of the conditional
log-probabilities scores the text. Classes of tokens come from counts over all documents: the most frequent words have
one each, all other words share hashed ones. The softmax has two levels, a group of classes and a class of the group,
whose biases start at the counted frequencies. The network is trained in numpy on every token of every document: documents
are dealt to shards by hash, every shard descends from the same weights, and the weights are averaged by tokens seen. Shards
follow from the number of tokens alone, and rows of a shard are in the order of a hash, so another layout of the same rows
gives the same scores but for the last digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos.llm import common

#: Classes: 0 is beyond the ends of a text, then words by falling frequency, then hashed classes of all other words.
GROUPS, PER_GROUP = 48, 48
CLASSES = GROUPS * PER_GROUP
HASHED = 512
WORDS = CLASSES - HASHED - 1
HIDDEN = 16
#: Tokens before and after.
SIDES = (-2, -1, 1, 2)
#: Tokens trained on at once, and scored at once.
BATCH, CHUNK = 4096, 8192
#: Tokens of a shard: no fewer than the first, and no more than the second once there are ``SHARDS`` shards.
SHARD_LEAST, SHARD_MOST, SHARDS = 1 << 20, 1 << 24, 64
#: Weights that travel as one row.
BLOCK = 4096

SHAPES = ((len(SIDES), CLASSES, HIDDEN), (HIDDEN,), (GROUPS, HIDDEN), (GROUPS,), (GROUPS, PER_GROUP, HIDDEN), (GROUPS, PER_GROUP))
SIZES = [int(np.prod(s)) for s in SHAPES]

#: A-Z to a-z.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: 0: white space, between tokens; 1: a mark, a token of its own; 2: any other byte.
KIND = np.array([0 if b in b" \t\n\x0b\x0c\r" else 1 if b in b".,;:!?" else 2 for b in range(256)], np.uint8)
#: Bytes whose tokens are hashed at once.
PIECE = 1 << 18
ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ODD and of its inverse, modulo 2 ** 64."""
    up, down = np.full(n, ODD, np.uint64), np.full(n, pow(ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens of ``data`` start and end."""
    kind = np.concatenate(([0], KIND[data], [0])).astype(np.uint8)
    here, before = kind[1:-1], kind[:-2]
    first = (here > 0) & ((before != 2) | (here == 1))
    after = kind[2:]
    last = (here > 0) & ((after != 2) | (here == 1))
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def token_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit hash of every token of ``data``, and where the token starts.

    Tokens are runs of bytes between white space, A-Z lowered; each of the marks . , ; : ! ? is a token. A token's hash is
    its polynomial in ODD, out of running sums over all of ``data``, so that Python touches no single token.
    """
    at = np.frombuffer(data.translate(LOWER), np.uint8)
    starts, ends = _starts(at)
    up, down = _powers(max(PIECE, 1 << max(0, len(at) - 1).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((at.astype(np.uint64) + np.uint64(1)) * up[: len(at)])))
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32), starts


def pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces of about ``PIECE`` bytes that end at white space."""
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            cut = max(data.rfind(b" ", at, end), data.rfind(b"\n", at, end))
            # A token longer than a piece is not cut.
            end = cut + 1 if cut >= at else min((x for x in (data.find(b" ", end), data.find(b"\n", end)) if x >= 0), default=len(data) - 1) + 1
        yield data[at:end]
        at = end


def hashes_of(texts: list[bytes]) -> list[bytes]:
    """The token hashes of each text, four bytes each; short texts are hashed together."""
    out: list[bytes] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            h, starts = token_hashes(b" ".join(held))
            ends = np.cumsum([len(x) + 1 for x in held])
            cuts = np.searchsorted(starts, ends)
            out.extend(x.astype("<u4").tobytes() for x in np.split(h, cuts[:-1]))
        held, size = [], 0

    for text in texts:
        if len(text) >= PIECE:
            flush()
            out.append(b"".join(token_hashes(x)[0].astype("<u4").tobytes() for x in pieces(text)))
        else:
            if size + len(text) >= PIECE:
                flush()
            held.append(text)
            size += len(text) + 1
    flush()
    return out


def hashed_tokens(docs: DataFrame) -> DataFrame:
    """``(doc_id, hashes)`` per row of ``docs(doc_id, text)``: the hash of every token of the whole text, four bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(hashes_of(texts), pa.binary())], ["doc_id", "hashes"])

    text = F.col("text").cast("string").cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, hashes binary")


def word_counts(hashed: DataFrame) -> DataFrame:
    """``(word, n)`` of every different token hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), return_counts=True)
            yield pa.record_batch([pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return hashed.select("hashes").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Classes:
    """Class of each token hash, and how often each class occurs in all documents."""

    def __init__(self, top: list[int], counts: np.ndarray) -> None:
        self.by_hash = np.argsort(np.array(top, np.uint32)).astype(np.int64)
        self.sorted = np.array(top, np.uint32)[self.by_hash]
        self.counts = counts

    def of(self, hashes: np.ndarray) -> np.ndarray:
        other = CLASSES - HASHED + (hashes % np.uint32(HASHED)).astype(np.int64)
        if not len(self.sorted):
            return other.astype(np.uint16)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.by_hash[at] + 1, other).astype(np.uint16)


def classes(counted: DataFrame) -> Classes:
    """The classes out of ``counted(word, n)``; what comes to the driver is one row per class, however many words there are."""
    top = counted.orderBy(F.desc("n"), "word").limit(WORDS).collect()
    counts = np.zeros(CLASSES, np.int64)
    counts[1 : len(top) + 1] = [r["n"] for r in top]
    rest = F.pmod("word", F.lit(HASHED))
    for r in counted.groupBy(rest.alias("k")).agg(F.sum("n").alias("n")).collect():
        counts[CLASSES - HASHED + r["k"]] = r["n"]
    for r in top:
        counts[CLASSES - HASHED + r["word"] % HASHED] -= r["n"]
    return Classes([r["word"] for r in top], counts)


def encode(hashed: DataFrame, known: Classes) -> DataFrame:
    """``(doc_id, ids)`` per row of ``hashed(doc_id, hashes)``: the class of every token, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [known.of(np.frombuffer(x, "<u4")).astype("<u2").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return hashed.mapInArrow(run, "doc_id long, ids binary")


def initial(counts: np.ndarray, seed: int = 5) -> list[np.ndarray]:
    """Weights that predict every class as often as it occurs, whatever stands around it."""
    rng = np.random.default_rng(seed)
    often = np.log((counts + 0.5) / (counts.sum() + 0.5 * CLASSES)).reshape(GROUPS, PER_GROUP).astype(np.float32)
    drawn = lambda shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return [drawn(SHAPES[0], 0.1), np.full(SHAPES[1], 0.1, np.float32), drawn(SHAPES[2], 0.1), np.log(np.exp(often).sum(axis=1)), drawn(SHAPES[4], 0.1), often]


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all ``texts`` in one row, two zeros before, between and after them; and the places of the tokens."""
    gap = bytes(4)
    row = np.frombuffer(gap + gap.join(texts) + gap, "<u2").astype(np.int64)
    return row, np.flatnonzero(row)


def _hidden(weights: list[np.ndarray], row: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = weights[0][0].take(row[at + SIDES[0]], axis=0)
    for k in range(1, len(SIDES)):
        h += weights[0][k].take(row[at + SIDES[k]], axis=0)
    h += weights[1]
    return np.maximum(h, 0, out=h)


def _by_group(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """``at`` sorted by the group of the token there; groups, places within them, and (group, from, to)."""
    group = (row[at] // PER_GROUP).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    at, group = at[order], group[order]
    ends = np.cumsum(np.bincount(group, minlength=GROUPS))
    starts = np.concatenate(([0], ends[:-1]))
    return at, group, row[at] % PER_GROUP, [(g, int(starts[g]), int(ends[g])) for g in np.flatnonzero(ends > starts)]


def _log_softmax(logits: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of ``own`` per column, and the columns' sums of what ``logits`` become: their exponentials."""
    if logits.max() > 60:
        logits -= logits.max(axis=0)
    found = logits[own, np.arange(len(own))]
    np.exp(logits, out=logits)
    total = logits.sum(axis=0)
    return found - np.log(total), total


def _errors(logits: np.ndarray, own: np.ndarray) -> None:
    """``logits`` become probabilities, less one for ``own``, per column."""
    _, total = _log_softmax(logits, own)
    logits *= 1 / total
    logits[own, np.arange(len(own))] -= 1


def log_probabilities(weights: list[np.ndarray], row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-probability of the token at each place of ``at`` given those around it."""
    out = np.zeros(len(row), np.float64)
    for i in range(0, len(at), CHUNK):
        some, group, inner, parts = _by_group(row, at[i : i + CHUNK])
        h = np.ascontiguousarray(_hidden(weights, row, some).T)
        found = _log_softmax(weights[2] @ h + weights[3][:, None], group)[0]
        for g, a, b in parts:
            found[a:b] += _log_softmax(weights[4][g] @ h[:, a:b] + weights[5][g][:, None], inner[a:b])[0]
        out[some] = found
    return out[at]


def gradients(weights: list[np.ndarray], row: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
    """Of the summed negative log-probabilities at ``at``: (which weights, their index, gradient), the output first."""
    at, group, inner, parts = _by_group(row, at)
    h = np.ascontiguousarray(_hidden(weights, row, at).T)
    p = weights[2] @ h
    p += weights[3][:, None]
    _errors(p, group)
    back = weights[2].T @ p
    outer = [(2, slice(None), p @ h.T), (3, slice(None), p.sum(axis=1))]
    for g, a, b in parts:
        own = h[:, a:b]
        p = weights[4][g] @ own
        p += weights[5][g][:, None]
        _errors(p, inner[a:b])
        back[:, a:b] += weights[4][g].T @ p
        outer += [(4, g, p @ own.T), (5, g, p.sum(axis=1))]
    yield from outer
    back *= h > 0
    yield 1, slice(None), back.sum(axis=1)
    back = back.astype(np.float64)
    for k, side in enumerate(SIDES):
        x = row[at + side]
        rows = np.flatnonzero(np.bincount(x, minlength=CLASSES))
        yield 0, (k, rows), np.stack([np.bincount(x, weights=b, minlength=CLASSES)[rows] for b in back], axis=1)


def descend(weights: list[np.ndarray], squares: list[np.ndarray], row: np.ndarray, at: np.ndarray, rate: float) -> None:
    """Adagrad over the tokens at ``at`` in batches, in place."""
    for i in range(0, len(at), BATCH):
        for which, where, g in gradients(weights, row, at[i : i + BATCH]):
            s = squares[which][where]
            s = s + g * g
            squares[which][where] = s
            weights[which][where] -= rate * g / np.sqrt(s)


def _flat(weights: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def _shaped(flat: np.ndarray) -> list[np.ndarray]:
    return [x.reshape(s).astype(np.float32) for x, s in zip(np.split(flat, np.cumsum(SIZES)[:-1]), SHAPES, strict=True)]


def _train(start: list[np.ndarray], rate: float):
    """mapInArrow body: ``(shard, ids)`` sorted by shard to blocks of (the sum over tokens of the weights, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(sum(SIZES)), 0
        shard, weights, squares, own = None, [], [], 0

        def finish() -> None:
            nonlocal seen, own, total
            if own:
                total += _flat(weights).astype(np.float64) * own
                seen += own
            own = 0

        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if shards[a] != shard:
                    finish()
                    shard, weights, squares = shards[a], [w.copy() for w in start], [np.ones(w.shape, np.float32) for w in start]
                row, at = padded(batch.column(1).slice(a, b - a).to_pylist())
                descend(weights, squares, row, at, rate)
                own += len(at)
        finish()
        if seen:
            blocks = [total[i : i + BLOCK].astype("<f8").tobytes() for i in range(0, len(total), BLOCK)]
            yield pa.record_batch([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary()), pa.array([seen] * len(blocks), pa.int64())], ["block", "total", "n"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: blocks sorted by number to their means; holds one block."""
    last, total, seen = None, None, 0
    done: list[tuple] = []
    for batch in batches:
        for block, data, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != last:
                if last is not None:
                    done.append((last, (total / seen).tobytes()))
                last, total, seen = block, np.zeros(len(data) // 8), 0
            total += np.frombuffer(data, "<f8")
            seen += n
    if last is not None:
        done.append((last, (total / seen).tobytes()))
    if done:
        yield pa.record_batch([pa.array([x[0] for x in done], pa.int32()), pa.array([x[1] for x in done], pa.binary())], ["block", "mean"])


def shards_of(n_tokens: int) -> int:
    """Shards for so many tokens: of ``SHARD_LEAST`` tokens up to ``SHARDS`` of them, then growing to ``SHARD_MOST`` each."""
    return max(1, min(SHARDS, n_tokens // SHARD_LEAST), -(-n_tokens // SHARD_MOST))


def fit(encoded: DataFrame, counts: np.ndarray, rate: float = 0.1, rounds: int = 1) -> list[np.ndarray]:
    """The weights, trained ``rounds`` times on every token of ``encoded(doc_id, ids)``. What comes to the driver is one
    number per weight, however many shards there are. Without tokens the weights stay as they start."""
    weights = initial(counts)
    shards = shards_of(int(counts.sum()))
    mixed = F.xxhash64("doc_id", "ids")
    dealt = common.tuned(encoded.select(F.pmod(mixed, F.lit(shards)).cast("int").alias("shard"), mixed.alias("mixed"), "ids"), ["shard"]).sortWithinPartitions("shard", "mixed")
    for k in range(rounds):
        parts = dealt.select("shard", "ids").mapInArrow(_train(weights, rate / (k + 1)), "block int, total binary, n long")
        means = common.tuned(parts, ["block"]).sortWithinPartitions("block").mapInArrow(_summed, "block int, mean binary").collect()
        if not means:
            break
        weights = _shaped(np.concatenate([np.frombuffer(bytes(r["mean"]), "<f8") for r in sorted(means)]))
    return weights


def score(encoded: DataFrame, weights: list[np.ndarray]) -> DataFrame:
    """``doc_id, n_tokens, pseudo_log_likelihood, mean_log_probability`` per row of ``encoded(doc_id, ids)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(1).to_pylist()
            n = np.array([len(x) // 2 for x in data], np.int64)
            sums = np.zeros(len(data))
            # Texts are scored together until a chunk is full.
            first, held = 0, 0
            for i, size in enumerate(n.tolist()):
                held += size
                if held >= CHUNK or i == len(data) - 1:
                    found = log_probabilities(weights, *padded(data[first : i + 1]))
                    owner = np.repeat(np.arange(first, i + 1), n[first : i + 1])
                    sums[first : i + 1] = np.bincount(owner - first, weights=found, minlength=i + 1 - first)
                    first, held = i + 1, 0
            means = pa.array(np.divide(sums, n, out=np.zeros(len(n)), where=n > 0), pa.float64(), mask=n == 0)
            yield pa.record_batch([batch.column(0), pa.array(n), pa.array(sums), means], ["doc_id", "n_tokens", "pseudo_log_likelihood", "mean_log_probability"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, pseudo_log_likelihood double, mean_log_probability double")


def pseudo_likelihood(docs: DataFrame, rounds: int = 1) -> DataFrame:
    """``doc_id, n_tokens, pseudo_log_likelihood, mean_log_probability`` per row of ``docs(doc_id, text)``.

    The network is trained on every token of all documents; a text's sum runs over all its tokens. Texts without a token
    (null, empty) have sum 0 and mean null; repeated rows score alike; other columns are ignored; an empty table gives no
    rows. Texts are split into tokens once; all else reads four, then two bytes per token.
    """
    hashed = common.materialize(hashed_tokens(docs), "hashed")
    known = classes(common.materialize(word_counts(hashed), "words"))
    encoded = common.materialize(encode(hashed, known), "encoded")
    return score(encoded, fit(encoded, known.counts, rounds=rounds))
