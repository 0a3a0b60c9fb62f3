import math
import random

import numpy as np
import pytest

from pelagos.llm import pivots

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, asked, k, scale=256):
    """(query, rank, id, score) by all inner products."""
    whole = lambda rows: sorted({(r[0], tuple(math.floor(scale * x) for x in r[1])) for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])})
    held, out = whole(rows), []
    for own, q in whole(asked):
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), i) for i, v in held if i != own)[:k]
        out += [(own, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def searched(df, asked, k, **sizes):
    return sorted(map(tuple, pivots.top_products(df, asked, k, **sizes).select("query_id", "rank", "vec_id", "score").collect()))


def test_whole_table_against_all_products(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = df.where("vec_id % 7 = 0")
    rows, q = [tuple(r) for r in df.collect()], [tuple(r) for r in asked.collect()]
    assert searched(df, asked, 5) == plain(rows, q, 5)
    assert searched(df.repartition(5), asked, 3, pivots=5, sample=40, query_block=16, row_block=50) == plain(rows, q, 3)


def test_clusters_ties_and_lengths(spark):
    """Clusters of unequal lengths, one vector a third of all rows, zero vectors, ties: small blocks and pairs that are never met."""
    random.seed(2)
    centres = [[random.gauss(0, 4) for _ in range(6)] for _ in range(8)]
    rows = [(i, [c + random.gauss(0, 0.1) for c in centres[i % 8]], 0) for i in range(400)]
    rows += [(1000 + i, [1.0, 0.0, -0.5, 0.25, 0.0, 2.0], 0) for i in range(200)] + [(2000 + i, [0.0] * 6, 0) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = df.where("vec_id % 20 = 0")
    assert searched(df, asked, 5, pivots=8, sample=300, query_block=4, row_block=32) == plain(rows, [r for r in rows if r[0] % 20 == 0], 5)


def test_candidates_are_eliminated():
    """In clustered data the bounds leave a small part of the rows to evaluate, and nothing of the answer is lost."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 300, (40, 8))
    x = np.floor(np.repeat(centres, 100, 0) + rng.normal(0, 5, (4000, 8))).astype(np.int64)
    r2 = float((x**2).sum(1).max())
    at = pivots.spread(x[::4], r2, 32)
    space = pivots.Space(8, r2, at, np.sqrt(r2 - (at.astype(float) ** 2).sum(1)))
    dx, ids, evaluated = np.ascontiguousarray(pivots.to_pivots(x, space, False).T), np.arange(4000), 0
    for i in range(0, 4000, 97):
        found, scores, n = pivots.best(x[i], pivots.to_pivots(x[i : i + 1], space, True)[0], i, -np.inf, x, dx, ids, space, 5)
        all_scores = x @ x[i]
        order = [j for j in np.lexsort((ids, -all_scores)) if j != i][:5]
        assert found.tolist() == order and scores.tolist() == all_scores[order].tolist()
        evaluated += n
    assert evaluated < 0.25 * 4000 * 42


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 2), (50, [1.0, 2.0], 1), (50, [-1.0, 0.5], 1), (1, None, 1), (2, [], 1), (3, [None, 1.0], 1), (4, [float("nan"), 1.0], 1),
        (5, [float("inf"), 1.0], 1), (None, [9.0, 9.0], 1), (6, [0.0, 0.0], None), (7, [3.0], 1), (8, [1.0, 2.0, -5.0], 1), (2**62, [1.0, 2.0], 1), (100, [-0.001, 0.001], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    padded = [(r[0], None if r[1] is None else [*r[1], *[0.0] * (3 - len(r[1]))], r[2]) for r in rows]
    found = pivots.top_products(df, df.where("vec_id % 50 = 0"), 5, row_block=3, query_block=2).collect()
    got, want = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found), plain(padded, [r for r in padded if r[0] is not None and r[0] % 50 == 0], 5)
    assert got == want and {r[0] for r in got} == {0, 50, 100}
    assert searched(df.limit(0), df.limit(0), 5) == [] and searched(df, df.where("false"), 5) == []
    alone = df.where("vec_id = 100")
    assert searched(alone, alone, 5) == []
    with pytest.raises(ValueError, match="64 bits"):
        searched(spark.createDataFrame([(0, [1e30], 0), (1, [1e30], 0)], SCHEMA), alone, 5)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0], i) for i in range(60)], SCHEMA).selectExpr("vec_id", "embedding", "label AS id", "label AS x", "label AS d", "label AS block", "label AS v", "label AS `a.b`")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert searched(df, df.where("vec_id % 50 = 0"), 5) == plain(rows, [r for r in rows if r[0] % 50 == 0], 5)
