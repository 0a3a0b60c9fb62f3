import random
import re
import time
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pelagos.llm import common, simhash


def brute(rows):
    def fp(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = {d: fp(t) for d, t in rows}
    group = {d: d for d in fps}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                group[max(x, y)] = min(x, y)
    return {d: (fps[d], root(d)) for d in ids}


def test_matches_brute_force(documents):
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(documents).collect()}
    assert got == brute([(r.doc_id, r.text) for r in documents.collect()])


def grouped(n, linked):
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            if group[i] != group[j] and linked(i, j):
                hi, lo = max(group[i], group[j]), min(group[i], group[j])
                group = [lo if g == hi else g for g in group]
    return group


@pytest.mark.parametrize("sheet", [16, 100])
def test_many_near_fingerprints_in_pairs_of_sheets(spark, monkeypatch, sheet):
    monkeypatch.setattr(simhash, "SHEET", sheet)
    monkeypatch.setattr(simhash, "STEP", 8)
    fps = [(i * 0x9E3779B97F4A7C15 ^ (1 << i % 64)) % (1 << 12) | (i % 7) << 40 for i in range(400)]
    fps = sorted(set(fps))
    points = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "f0 long, node long")
    keys = [F.col("f0").bitwiseAND(F.lit(simhash._signed(m))) for m in simhash.block_masks(3, 4)]
    got = {r.node: r.component for r in common.components(simhash.links(points, keys, 1, 3)).collect()}
    want = grouped(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert {i: got.get(i, i) for i in range(len(fps))} == dict(enumerate(want))


def test_one_component_needs_no_pairs_of_sheets(spark, monkeypatch):
    """Rows of one large group of near copies are dealt twice, then once more: not once per other sheet."""
    monkeypatch.setattr(simhash, "SHEET", 64)
    rows = [(7, i, (1 << i % 60) | (1 << i // 60)) for i in range(1200)]
    dealt = []
    real = common.tuned
    monkeypatch.setattr(common, "tuned", lambda df, by, factor=1: dealt.append(df.count()) or real(df, by, factor))
    edges = simhash.sheet_links(spark.createDataFrame(rows, "key long, node long, f0 long"), 1, 4)
    assert {r.component for r in common.components(edges).collect()} == {0}
    assert dealt[0] == 2400 and dealt[-1] <= 1.5 * 1200


def test_memory_of_a_sheet_of_near_rows():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 4, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, (2048, 4), dtype=np.uint64))
    fps = fps[np.argsort(np.bitwise_count(fps).sum(axis=1), kind="stable")]
    tracemalloc.start()
    label = simhash._tile_labels(fps, 0, 56)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (label == 0).all() and peak < 16 << 20
    label = simhash._tile_labels(fps, 0, 56, lambda a, b: True)
    assert (label == 0).all()


def family(rng, n, similarity, size=400):
    """Shingle sets of ``n`` variants of one text, any two with about that Jaccard similarity, and fingerprints in a radius."""
    keep = 2 * similarity / (1 + similarity)  # share of a variant's shingles that all variants have
    common_part = rng.choice(1 << 30, int(size * keep), replace=False).astype(np.uint32)
    sets = [np.unique(np.concatenate((common_part, rng.integers(1 << 30, 1 << 32, size - len(common_part), dtype=np.uint64).astype(np.uint32)))).tobytes() for _ in range(n)]
    fps = rng.integers(0, 1 << 63, 4, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, (n, 4), dtype=np.uint64))
    return np.array(sets, object), fps


def test_a_sheet_of_unlike_variants_is_decided_at_once():
    """Template pages: 2,048 rows inside the radius of which no two reach 0.8; asked pair by pair they take minutes."""
    sets, fps = family(np.random.default_rng(1), 2048, 0.7)
    start = time.perf_counter()
    label = simhash._tile_labels(fps[np.argsort(np.bitwise_count(fps).sum(axis=1), kind="stable")], 0, 56, simhash.Alike(sets, 0.8))
    assert time.perf_counter() - start < 10
    assert (label == np.arange(2048)).all()


def test_tiles_decide_as_single_pairs_do(monkeypatch):
    rng = np.random.default_rng(2)
    parts = [family(rng, 40, s) for s in (0.78, 0.8, 0.83, 0.95)]
    sets = np.concatenate([p[0] for p in parts] + [np.array([b"", b"", np.arange(3, dtype=np.uint32).tobytes()], object)])
    alike = simhash.Alike(sets, 0.8)
    x, y = np.triu_indices(len(sets), 1)
    one_by_one = np.array([alike(a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True)])
    assert (alike.many(x, y) == one_by_one).all() and 0 < one_by_one.sum() < len(x)
    monkeypatch.setattr(simhash, "COLUMNS", 7)
    assert (alike.many(x, y) == one_by_one).all()
    fps = np.zeros((len(sets), 4), np.uint64)
    want = simhash._joined(np.arange(len(sets)), x[one_by_one], y[one_by_one])
    for patience in (0, 3, 10**9):
        monkeypatch.setattr(simhash, "PATIENCE", patience)
        assert (simhash._tile_labels(fps, 0, 56, alike) == want).all()


def test_sheets_of_long_sets_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHEET_BYTES", 4000)
    sets = [np.arange(i // 10 * 1000, i // 10 * 1000 + 100 + i % 10, dtype=np.uint32).tobytes() for i in range(60)]
    rows = [(1, i, 0, bytearray(x)) for i, x in enumerate(sets)]
    edges = simhash.sheet_links(spark.createDataFrame(rows, "key long, node long, f0 long, shingles binary"), 1, 3, 0.8)
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {i: i // 10 * 10 for i in range(60)}


def test_awkward_rows(awkward, nothing):
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(awkward).collect()]
    assert len(got) == awkward.count()
    assert {c for d, c in got if d in (2, 3, 4)} == {2}
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.deduplicate(awkward)
    assert kept.columns == awkward.columns and kept.where(F.col("doc_id") == 1).count() == 1


def test_components_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_near_copies_of_that_similarity_go(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows, groups = [], []
    for g in range(60):
        text = [word() for _ in range(300)]
        rows.append((len(rows), " ".join(text)))
        members = [len(rows) - 1]
        for _ in range(g % 4):
            copy = list(text)
            for _ in range(4):  # 20 of 296 shingles change: similarity about 0.87
                copy[rng.randrange(300)] = word()
            members.append(len(rows))
            rows.append((len(rows), " ".join(copy)))
        groups.append(members)
        # Too different to go: every tenth word changed.
        rows.append((len(rows), " ".join(word() if i % 10 == 0 else w for i, w in enumerate(text))))
        groups.append([len(rows) - 1])
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {min(g) for g in groups} <= kept
    assert len(kept) <= 1.05 * len(groups)


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def test_pairs_at_the_threshold(spark):
    """Planted pairs of similarity 0.8 and just above: nine in ten at least go; pairs below 0.8 all stay."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    rows, above, below = [], set(), set()
    while len(above) < 300 or len(below) < 300:
        text = [word() for _ in range(400)]
        copy = list(text)
        for at in range(7, 400, rng.choice([46, 48, 50, 44, 42, 40])):
            copy[at] = word()
        s = jaccard(*(set(simhash.shingles(" ".join(t), 5)) for t in (text, copy)))
        side = above if 0.8 <= s < 0.82 else below if 0.76 < s < 0.8 else None
        if side is not None and len(side) < 300:
            rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(copy))]
            side.add(len(rows) - 1)
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert below <= kept
    assert len(above & kept) <= 0.1 * len(above)
    assert {i for i in range(0, len(rows), 2)} <= kept
