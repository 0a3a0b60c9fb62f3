"""SimHash near-duplicates: majority fingerprints of word shingles, compared exactly in tiles.

Fingerprints meet in buckets; inside a bucket, tiles of ``STEP`` by ``STEP`` rows sorted by population count are
compared with numpy exclusive-or and bit counts, and pairs of tiles whose population counts differ by more than the
radius are skipped. Two ways of dealing fingerprints to buckets:

* ``near_duplicates``: 64 bits and a small radius. The bits fall into blocks, and every choice of
  ``n_blocks - radius`` of them is a bucket key. Fingerprints within the radius agree on at least one choice, so no
  link is lost.
* ``deduplicate``: 256 bits and a wanted similarity of shingle sets. The keys are ``BANDS`` bands of ``ROWS`` least
  shingle hashes each, whose number does not depend on the number of rows. Texts within the radius of that similarity
  (three standard deviations allowed) form candidate clusters; inside those the tiles are compared again and every
  pair within the radius is decided by its exact shingle sets.

No bucket is gathered in one place: beyond ``SHEET`` rows it is dealt to sheets. First rows are dealt
twice at random and each sheet is compared with itself only; rows that this connects are then dealt together, so that
pairs of sheets of one component need no comparison. A
group of very many near copies thus costs its size, not its square. Of each sheet only a spanning forest of the links is
returned, and links are joined tile by tile, never listed for a whole sheet. Equal fingerprints are one row however many
documents share them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_digest

from pelagos.llm import common

#: Rows of one sheet; larger buckets become pairs of sheets.
SHEET = 2048
#: Bytes of shingle sets in one sheet.
SHEET_BYTES = 16 << 20
#: Rows and columns of a tile, compared at once.
STEP = 256
#: Keys of a text among its near duplicates, and least shingle hashes in each: texts of similarity 0.8 share a key with
#: probability 1 - (1 - 0.8 ** 3) ** 8 = 0.997.
BANDS, ROWS = 8, 3
#: Pairs of a tile that sets may refuse one by one before all that are left are decided at once; shingles taken at once then.
PATIENCE, COLUMNS = 128, 8192
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


# ---- fingerprints ---------------------------------------------------------------------------------


def shingles(text: str | None, width: int) -> list[bytes]:
    """Every ``width``-word shingle of ``text`` with A-Z lowered, repeats included.

    Fewer words than ``width``: the whole sequence; no word: none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    if len(words) < width:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def _votes(text: str | None, width: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of ``words`` numbers of 64 bits, and the hashes of the shingles in text order.

    A bit is set if it is set in over half of the shingles' hashes; zeros for no word. The first number is of XXH64
    with seed 42, the others of that hash mixed with odd constants.
    """
    parts = shingles(text, width)
    votes = np.zeros((words, 64), np.int64)
    hashes = []
    for i in range(0, len(parts), CHUNK):
        some = parts[i : i + CHUNK]
        # Digests are big-endian; turned round, bit b of the number is bit b of the bytes.
        hashed = np.frombuffer(b"".join([xxh64_digest(s, 42) for s in some]), ">u8").astype(np.uint64)
        hashes.append(hashed)
        for k in range(words):
            own = mixed(hashed, _odd(k)) if k else hashed
            votes[k] += np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = np.packbits(2 * votes.reshape(-1) > len(parts), bitorder="little").view("<u8")
    return fp, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)


@cache
def _odd(k: int) -> np.ndarray:
    return np.random.default_rng(k).integers(1 << 62, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)


def mixed(hashed: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """A rehash of 64-bit hashes: multiplied by two odd numbers, its halves folded after each."""
    out = hashed * odd[..., 0]
    out ^= out >> np.uint64(32)
    out *= odd[..., 1]
    return out ^ out >> np.uint64(29)


def majority(text: str | None, width: int, words: int) -> np.ndarray:
    """The fingerprint of ``text``: ``words`` numbers of 64 bits."""
    return _votes(text, width, words)[0]


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` keys, each of the least values of ``ROWS`` rehashes; texts with the same least values share the key."""
    if not len(hashes):
        return np.zeros(BANDS, np.uint64)
    odd = np.stack([_odd(64 + k) for k in range(BANDS * ROWS)])
    least = np.min([mixed(hashes[i : i + CHUNK // 8, None], odd).min(axis=0) for i in range(0, len(hashes), CHUNK // 8)], axis=0).reshape(BANDS, ROWS)
    folded = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        folded = mixed(folded ^ least[:, k], _odd(32 + k))
    return folded


def names(words: int) -> list[str]:
    return [f"f{k}" for k in range(words)]


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, banded: bool = False) -> DataFrame:
    """``(doc_id, tag, f0, ...)`` per row of ``docs(doc_id, text)``; each f holds 64 bits as a long, tag is a hash of
    the text; with ``banded``, band keys ``k0, ...`` too. Null text: no words."""
    made = names(words) + ([f"k{k}" for k in range(BANDS)] if banded else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(2):
                fp, hashes = _votes(x.as_py(), width, words)
                rows.append(np.concatenate([fp, band_keys(np.unique(hashes))]) if banded else fp)
            values = np.array(rows, np.uint64).reshape(-1, len(made)).view(np.int64)
            yield pa.record_batch([*batch.columns[:2], *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(len(made)))], ["doc_id", "tag", *made])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, tag long, " + ", ".join(f"{n} long" for n in made))


# ---- tiles ----------------------------------------------------------------------------------------


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``label`` (each row's least row known to be connected) after links between rows ``x`` and ``y``."""
    while len(x):
        one, two = label[x], label[y]
        apart = one != two
        if not apart.any():
            break
        x, y, one, two = x[apart], y[apart], one[apart], two[apart]
        high, at = np.unique(np.maximum(one, two), return_index=True)
        parent = np.arange(len(label))
        parent[high] = np.minimum(one, two)[at]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]
    return label


def _checked(label: np.ndarray, x: np.ndarray, y: np.ndarray, alike: Alike) -> np.ndarray:
    """As ``_joined``, of the links that ``alike`` confirms, the nearest first; those inside a component are not asked.

    Pairs are asked one by one while that joins rows, since each one joined spares many; after ``PATIENCE`` refusals all
    that are left are decided at once.
    """
    apart = label[x] != label[y]
    x, y = x[apart], y[apart]
    refused = 0
    while len(x) and refused < PATIENCE:
        asked = x[: PATIENCE - refused].tolist(), y[: PATIENCE - refused].tolist()
        at = next((i for i, (a, b) in enumerate(zip(*asked, strict=True)) if alike(a, b)), None)
        if at is None:
            refused += len(asked[0])
            x, y = x[len(asked[0]) :], y[len(asked[0]) :]
            continue
        refused += at
        label = _joined(label, x[at : at + 1], y[at : at + 1])
        x, y = x[at + 1 :], y[at + 1 :]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    if len(x):
        sure = alike.many(x, y)
        label = _joined(label, x[sure], y[sure])
    return label


def _tile_labels(fps: np.ndarray, cut: int, radius: int, alike: Alike | None = None) -> np.ndarray:
    """Per row its least row connected by links of ``radius`` bits or fewer (that ``alike`` confirms, if given).

    Rows below ``cut`` are compared with those from it on; ``cut`` 0: all with all. Either side comes sorted by
    population count. Tiles whose rows are one component already need no comparison.
    """
    pop = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    label = np.arange(len(fps))
    for i in range(0, cut or len(fps), STEP):
        i_end = min(i + STEP, cut or len(fps))
        for j in range(cut or i, len(fps), STEP):
            j_end = min(j + STEP, len(fps))
            if pop[j] - pop[i_end - 1] > radius or pop[i] - pop[j_end - 1] > radius:
                continue
            mine, other = label[i:i_end], label[j:j_end]
            if (mine == mine[0]).all() and (other == mine[0]).all():
                continue
            bits = np.bitwise_count(fps[i:i_end, None, 0] ^ fps[None, j:j_end, 0])
            if fps.shape[1] > 1:
                bits = bits.astype(np.uint16)
                for k in range(1, fps.shape[1]):
                    bits += np.bitwise_count(fps[i:i_end, None, k] ^ fps[None, j:j_end, k])
            near = bits <= radius
            near &= mine[:, None] != other[None, :]
            if i == j:
                near = np.triu(near, 1)  # every pair once
            x, y = np.nonzero(near)
            if alike is None:
                label = _joined(label, x + i, y + j)
            elif len(x):
                order = np.argsort(bits[x, y], kind="stable")
                label = _checked(label, x[order] + i, y[order] + j, alike)
    return label


class Alike:
    """Whether the shingle sets (sorted 32-bit hashes as bytes) of two rows reach a Jaccard similarity."""

    def __init__(self, sets: np.ndarray, similarity: float):
        self.sets, self.similarity = sets, similarity
        self.sizes = np.fromiter((len(s) // 4 for s in sets), np.int64, len(sets))

    def enough(self, both: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return both >= self.similarity * (self.sizes[x] + self.sizes[y] - both)

    def __call__(self, a: int, b: int) -> bool:
        small, large = sorted((a, b), key=self.sizes.__getitem__)
        if self.sizes[small] < self.similarity * self.sizes[large]:
            return False
        one, two = np.frombuffer(self.sets[small], np.uint32), np.frombuffer(self.sets[large], np.uint32)
        return bool(self.enough(len(np.intersect1d(one, two, assume_unique=True)), a, b))

    def many(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The answer for each pair, by one product of 0-1 matrices over the shingles that more than one row has."""
        sizes = np.sort(np.stack((self.sizes[x], self.sizes[y])), axis=0)
        out = sizes[0] >= self.similarity * sizes[1]
        if not out.any():
            return out
        rows, place = np.unique(np.concatenate((x[out], y[out])), return_inverse=True)
        values = np.frombuffer(b"".join(self.sets[r] for r in rows), np.uint32)
        row = np.repeat(np.arange(len(rows)), self.sizes[rows])
        order = np.argsort(values, kind="stable")
        first = np.concatenate(([True], values[order][1:] != values[order][:-1])) if len(order) else np.zeros(0, bool)
        column, times = np.cumsum(first) - 1, np.diff(np.append(np.flatnonzero(first), len(first)))
        shared = times[column] > 1
        number = np.cumsum(times > 1) - 1
        row, column = row[order][shared], number[column[shared]]
        both = np.zeros((len(rows), len(rows)), np.float32)
        cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + COLUMNS, COLUMNS))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            has = np.zeros((len(rows), COLUMNS), np.float32)
            has[row[a:b], column[a:b] - k * COLUMNS] = 1
            both += has @ has.T  # whole numbers below 2^24: exact
        n = int(out.sum())
        out[out] = self.enough(both[place[:n], place[n:]].astype(np.int64), x[out], y[out])
        return out


def _compare(words: int, radius: int, similarity: float | None):
    """mapInArrow body: rows ``(g, side, node, f0, ...)`` (and ``shingles`` where a similarity is wanted) sorted by g,
    side and population count, to links ``(a, b)``. Side 2 is compared with itself, side 0 with side 1."""

    def found(rows: list[np.ndarray], cuts: list[int]) -> pa.RecordBatch:
        fps = np.stack(rows[3 : 3 + words], axis=1).view(np.uint64)
        left, right = [], []
        for start, end in zip(cuts, cuts[1:], strict=False):
            side, node = rows[1][start:end], rows[2][start:end]
            if end - start < 2 or (side[0] != 2 and side[0] == side[-1]):
                continue
            alike = None if similarity is None else Alike(rows[-1][start:end], similarity)
            label = _tile_labels(fps[start:end], 0 if side[0] == 2 else int(np.searchsorted(side, 1)), radius, alike)
            lower = np.flatnonzero(label != np.arange(len(label)))
            left.append(node[lower])
            right.append(node[label[lower]])
        none = [np.zeros(0, np.int64)]
        return pa.record_batch([pa.array(np.concatenate(left or none)), pa.array(np.concatenate(right or none))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held:
                rows = [np.concatenate(p) for p in zip(held, rows, strict=True)]
            cuts = [0, *(np.flatnonzero(np.diff(rows[0])) + 1).tolist()]
            if len(cuts) > 1:
                yield found(rows, cuts)
            held = [r[cuts[-1] :] for r in rows]
        if held:
            yield found(held, [0, len(held[0])])

    return run


def sheet_links(rows: DataFrame, words: int, radius: int, similarity: float | None = None) -> DataFrame:
    """Links ``(a, b)`` that connect exactly what links between rows of the same ``key`` connect.

    ``rows(key, node, f0, ..., [shingles])`` is materialized; a node may have many keys. Links are of ``radius`` or
    fewer bits, confirmed by the sets in ``shingles`` where ``similarity`` is given. Keys beyond a sheet are compared
    in two rounds, as the module's text says.
    """
    fs = names(words)
    rest = ["node", *fs] + (["shingles"] if similarity is not None else [])
    held = F.length("shingles") if similarity is not None else F.lit(0)
    pop = sum((F.bit_count(f) for f in fs[1:]), F.bit_count(fs[0]))
    sheets = lambda n, size: F.greatest(F.ceil(n / SHEET), F.ceil(size / SHEET_BYTES)).cast("int")
    totals = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(held).alias("size")).where("n > 1")
    totals = common.materialize(totals.select("key", sheets(F.col("n"), F.col("size")).alias("sheets")), "totals")
    met = rows.join(totals, "key")

    def compared(dealt: DataFrame) -> DataFrame:
        sorted_rows = common.tuned(dealt, ["g"]).sortWithinPartitions("g", "side", pop)
        found = sorted_rows.select("g", F.col("side").cast("int").alias("side"), *rest).mapInArrow(_compare(words, radius, similarity), "a long, b long")
        return common.materialize(found, "links")

    # Large keys are dealt twice at random: what two dealings connect inside sheets is connected across them.
    salted = lambda k: F.xxhash64("key", F.lit(k), F.pmod(F.xxhash64("node", F.lit(k)), F.col("sheets")))
    sheet = F.explode(F.when(F.col("sheets") == 1, F.array("key")).otherwise(F.array(salted(1), salted(2))))
    first = compared(met.select(sheet.alias("g"), F.lit(2).alias("side"), *rest))
    if totals.where("sheets > 1").isEmpty():
        return first
    # Second round: rows of a component that fills sheets get sheets of their own, numbered from ``low`` to ``high``; the rest
    # share the last ``shared`` ones.
    large = common.materialize(met.where("sheets > 1").drop("sheets").join(components_of(first), "node", "left").withColumn("label", F.coalesce("label", "node")), "large")
    sized = large.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum(held).alias("size"))
    sized = sized.withColumn("own", F.when(sheets(F.col("n"), F.col("size")) > 1, sheets(F.col("n"), F.col("size"))).otherwise(0))
    whole = sized.groupBy("key").agg(
        F.sum("own").alias("owned"),
        F.coalesce(sheets(F.sum(F.when(F.col("own") == 0, F.col("n"))), F.sum(F.when(F.col("own") == 0, F.col("size")))), F.lit(0)).alias("shared"),
    )
    by_key = Window.partitionBy("key").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    owners = sized.where("own > 0").withColumn("low", F.coalesce(F.sum("own").over(by_key), F.lit(0)))
    dealt = large.join(whole, "key").join(owners.select("key", "label", "own", "low"), ["key", "label"], "left")
    own = F.when(F.col("own").isNotNull(), F.col("low") + F.pmod(F.xxhash64("node", F.lit(3)), F.col("own"))).otherwise(
        F.col("owned") + F.pmod(F.xxhash64("node", F.lit(3)), F.col("shared"))
    )
    last = F.col("owned") + F.col("shared") - 1
    other = F.when(
        F.col("own").isNotNull(),
        F.concat(
            F.when(F.col("low") > 0, F.sequence(F.lit(0).cast("long"), F.col("low") - 1)).otherwise(F.array().cast("array<bigint>")),
            F.when(F.col("low") + F.col("own") <= last, F.sequence(F.col("low") + F.col("own"), last)).otherwise(F.array().cast("array<bigint>")),
        ),
    ).otherwise(F.sequence(F.lit(0).cast("long"), last))
    pairs = dealt.withColumn("own_sheet", own.cast("long")).withColumn("other", F.explode(other))
    side = F.when(F.col("own_sheet") == F.col("other"), 2).when(F.col("own_sheet") < F.col("other"), 0).otherwise(1)
    placed = pairs.select(F.xxhash64("key", F.least("own_sheet", "other"), F.greatest("own_sheet", "other"), F.lit("second")).alias("g"), side.alias("side"), *rest)
    return first.unionByName(compared(placed))


def components_of(edges: DataFrame) -> DataFrame:
    return common.components(edges).withColumnRenamed("component", "label")


# ---- buckets --------------------------------------------------------------------------------------


def block_masks(radius: int, n_blocks: int) -> list[int]:
    """Bit masks of every choice of ``n_blocks - radius`` of ``n_blocks`` even blocks of 64 bits."""
    edges = [64 * i // n_blocks for i in range(n_blocks + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, n_blocks - radius)]


def blocks_for(n: int, radius: int) -> int:
    """Fewest blocks with which a bucket of ``n`` spread fingerprints holds about 64 rows or fewer."""
    k = radius + 1
    while k < 2 * radius + 2 and n > 64 << (64 * (k - radius) // k):
        k += 1
    return k


def radius_of(similarity: float, words: int) -> int:
    """Bits in which fingerprints of texts with that Jaccard similarity differ at most, three standard deviations allowed."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(64 * words * share + 3 * math.sqrt(64 * words * share * (1 - share)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(points: DataFrame, keys: list[Column], words: int, radius: int) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the nodes of ``points(node, f0, ...)`` chained by steps of ``radius`` or
    fewer bits, among rows that agree on at least one of ``keys``."""
    keyed = points.select("node", F.explode(F.array(*[F.xxhash64(F.lit(i), k) for i, k in enumerate(keys)])).alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1").select("key")
    # Only keys and nodes are shuffled for this; the fingerprints follow for rows that meet others.
    met = keyed.join(shared, "key")
    return sheet_links(common.materialize(met.join(points.select("node", *names(words)), "node"), "met"), words, radius)


def _points(prints: DataFrame, fs: list[str], *more: Column) -> DataFrame:
    """``(f0, ..., low, node, ...)`` per different fingerprint of ``prints``; nodes are its smallest doc_id, or a number
    made of its bits where it has none (``low`` null)."""
    stand_in = F.shiftrightunsigned(F.xxhash64(*fs), 3) + F.lit(1 << 61)
    points = prints.groupBy(*fs).agg(F.min("doc_id").alias("low"), *more).withColumn("node", F.coalesce("low", stand_in))
    return common.materialize(points, "points")


def _named(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``points`` with ``component``, the smallest node connected by ``edges``."""
    return points.join(common.components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs(doc_id, text)``.

    Documents whose 64-bit fingerprints differ in ``radius`` or fewer bits are linked; ``component_id`` is the smallest
    doc_id reachable, itself included. Null and empty texts have fingerprint zero and are linked like any other;
    repeated rows and doc_ids are allowed (each row is returned); other columns are ignored; an empty table gives
    no rows. The component of rows that reach no doc_id but null is null.
    """
    prints = common.materialize(fingerprints(docs, width), "fingerprints")
    points = _points(prints, ["f0"])
    masks = block_masks(radius, blocks_for(points.count(), radius))
    label = _named(points, links(points, [F.col("f0").bitwiseAND(F.lit(_signed(m))) for m in masks], 1, radius))
    label = common.materialize(label.select("f0", "low", "node", "component"), "labels")
    known = label.where("low is not null").groupBy("component").agg(F.min("low").alias("component_id"))
    named = label.join(known, "component", "left").select("f0", "component_id")
    return prints.join(named, "f0").select("doc_id", F.col("f0").alias("fp"), "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """``(node, shingles)`` per row of ``texts(node, text)``: the sorted 32-bit hashes of its different shingles, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(_votes(x.as_py(), width, 0)[1] >> np.uint64(32)).astype(np.uint32).tobytes() for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles binary")


def _keys(tag: Column) -> Column:
    """One key of a row by doc_id and text hash ``tag``, the null id told apart."""
    doc_id = F.col("doc_id").cast("long")
    return F.struct(F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(tag, doc_id.isNull()).alias("tag"))


def deduplicate(docs: DataFrame, width: int = 5, similarity: float = 0.8, words: int = 4) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest doc_id (null last).

    Texts are linked if the sets of their ``width``-word shingles (A-Z lowered) have Jaccard ``similarity`` or more;
    groups are connected by links. Candidates are texts that share a band key, and chains of them, within the radius of
    that similarity in fingerprints of ``64 * words`` bits: a pair of just that similarity is missed by the keys with
    probability 0.003 and by the radius with 0.001. Texts without words are one group. Repeated rows are one; columns
    are kept, whatever their names.
    """
    fs, radius = names(words), radius_of(similarity, words)
    prints = common.materialize(fingerprints(docs, width, words, banded=True), "fingerprints")
    bands = [f"k{k}" for k in range(BANDS)]
    points = _points(prints, fs, F.min("tag").alias("tag"), F.min_by("doc_id", "tag").alias("doc_id"), *[F.min(k).alias(k) for k in bands])
    # Candidate clusters, then what the exact sets confirm inside them.
    clusters = common.materialize(common.components(links(points, [F.col(k) for k in bands], words, radius)), "clusters")
    wanted = clusters.join(points, "node").select("node", _keys(F.col("tag")).alias("key"))
    tagged = docs.select(common.packed(docs), _keys(F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))).alias("key"))
    texts = tagged.join(common.small_or_shuffled(common.materialize(wanted, "wanted")), "key").select("node", F.col("row.text").cast("string").alias("text"))
    sets = common.materialize(_shingle_sets(texts.dropDuplicates(["node"]), width), "shingles")
    rows = clusters.withColumnRenamed("component", "key").join(points.select("node", *fs), "node").join(sets, "node").select("key", "node", *fs, "shingles")
    label = _named(points, sheet_links(common.materialize(rows, "members"), words, radius, similarity))
    group = prints.join(label.select(*fs, "component"), fs)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag")
    picked = group.groupBy("component").agg(F.min(order).alias("k")).select("k.doc_id", "k.tag")
    # Both sides by one key: the texts are shuffled once for join and distinct.
    keep = common.materialize(picked.select(_keys(F.col("tag")).alias("key")), "kept")
    return tagged.join(keep, "key", "left_semi").dropDuplicates(["key"]).select(*common.unpacked(docs))
