"""Exact search for the k greatest inner products by pivot tables.

An inner product is turned into a distance: a row x gets one more component, so that all rows have the length R of
the longest, and a query q gets a zero there; then |q - x|^2 = |q|^2 + R^2 - 2<q, x>, and the nearest rows are those
of greatest product. Distances from every row to some pivots are worked out once. By the triangle inequality
|d(q, p) - d(x, p)| is a lower bound on the distance of q and x for each pivot p; the greatest of them decides:

1. Rows are ordered by their nearest pivot and cut into blocks, queries too. Of every block the least and greatest
   distance to each pivot are known.
2. Each block of queries meets the blocks where the cells of its queries begin first. That gives every query
   a score which its k-th neighbour has at least.
3. Of all other pairs of blocks only those meet whose bounds can reach that score. Inside a pair the candidates of a
   query are taken in the order of their bounds and evaluated exactly until no bound left can reach the k-th score.

Bounds are in floating point and widened by more than their error; scores are whole numbers and exact. Blocks have a
fixed size, so one very common vector is in many blocks and no group grows with the data; rows are copied once
for each block of queries that they may answer.

Rows whose id or vector is null, and vectors that hold a null or non-finite component, take no part. Shorter vectors
count as if filled up with zeros. Repeated rows count once; of different rows with one id each is a candidate, and
none is a candidate of a query with that id. With fewer than k candidates all are returned; none without queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.llm import common

#: A part of R^2 by which bounds on scores are widened; the error of sqrt near zero is some 2e-8 of R.
SLACK = 1e-6
FOUND = "query long, of long, id long, score long"


class Space(NamedTuple):
    """What all tasks know: number of components, squared length of the longest row, pivots and their last component."""

    dim: int
    r2: float
    pivots: np.ndarray
    last: np.ndarray


def whole_numbers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of every component, null if the vector is null or one is null or not finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(finite, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists of whole numbers as the rows of a matrix of ``dim`` columns, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), dim), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def to_pivots(x: np.ndarray, space: Space, queries: bool) -> np.ndarray:
    """Distances of the rows of ``x`` to the pivots, as queries or as candidates."""
    own = (x.astype(float) ** 2).sum(1)
    products = x.astype(float) @ space.pivots.T.astype(float)
    if queries:
        squared = own[:, None] + space.r2 - 2 * products
    else:
        squared = 2 * space.r2 - 2 * products - 2 * np.sqrt(np.maximum(space.r2 - own, 0))[:, None] * space.last
    return np.sqrt(np.maximum(squared, 0))


def spread(sample: np.ndarray, r2: float, most: int) -> np.ndarray:
    """At most ``most`` rows of ``sample``, each as far as can be from those before it."""
    last = np.sqrt(np.maximum(r2 - (sample.astype(float) ** 2).sum(1), 0))
    x = np.column_stack((sample.astype(float), last))
    chosen, far = [], np.full(len(x), np.inf)
    while len(chosen) < min(most, len(x)) and (not chosen or far.max() > 0):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def space_of(rows: DataFrame, pivots: int, sample: int) -> Space:
    """Sizes over all rows, and pivots out of the ``sample`` rows whose ids have the least hashes."""
    dim, r2, top = rows.select(F.size("v").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x).alias("r2"), F.array_max(F.transform("v", F.abs)).alias("top")).agg(F.max("n"), F.max("r2"), F.max("top")).first()
    dim, r2, top = dim or 0, r2 or 0.0, top or 0
    if top < 0 or dim * max(top, 1) ** 2 >= 2**63:
        raise ValueError("inner products of these vectors exceed 64 bits")
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    at = spread(matrix(some.column("v"), dim), r2, pivots)
    return Space(dim, r2, at, np.sqrt(np.maximum(r2 - (at.astype(float) ** 2).sum(1), 0)))


def with_distances(rows: DataFrame, space: Space, queries: bool) -> DataFrame:
    """``(id, x, own, d, cell, near)``: packed vector and its squared length, distances to the pivots, the nearest of them
    and how near it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), space.dim)
            d = to_pivots(x, space, queries)
            cell = d.argmin(1)
            packed = pa.array([r.tobytes() for r in x], pa.binary())
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * d.shape[1], d.ravel())
            own = pa.array((x.astype(float) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), packed, own, lists, pa.array(cell, pa.int32()), pa.array(d.min(1))], names=["id", "x", "own", "d", "cell", "near"])

    return rows.select("id", "v").mapInArrow(run, "id long, x binary, own double, d array<double>, cell int, near double")


def in_blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """``rows`` with ``block``: their place in the order of cell and distance divided by ``size``."""
    order = [F.col(c).asc() for c in ("cell", "near", "id", "x")]
    placed = common.ordered_index(common.materialize(rows, name), order)
    return common.materialize(placed.withColumn("block", F.floor(F.col("idx") / size)), name)


def reach(rows: DataFrame, pivots: int, *more: Column) -> DataFrame:
    """Least and greatest distance to each pivot of every block, as two lists."""
    ends = [f(F.get("d", F.lit(i))).alias(f"{n}{i}") for i in range(pivots) for n, f in (("lo", F.min), ("hi", F.max))]
    lists = [F.array(*[F.col(f"{n}{i}") for i in range(pivots)]).alias(n) for n in ("lo", "hi")]
    names = [c for c in rows.groupBy("block").agg(*more).columns if c != "block"] if more else []
    return rows.groupBy("block").agg(*ends, *more).select("block", *lists, *names)


def best(q: np.ndarray, dq: np.ndarray, own: int, floor: float, x: np.ndarray, dx: np.ndarray, ids: np.ndarray, space: Space, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the ``k`` best rows for one query, and how many were evaluated. ``floor``: a score that the
    k-th has at least; rows below it are left out. ``dx`` has a row for each pivot."""
    low = np.zeros(len(ids))
    for p in range(len(dx)):
        np.maximum(low, np.abs(dx[p] - dq[p]), out=low)
    bound = (float(q @ q) + space.r2 - low * low) / 2 + SLACK * space.r2 + 1
    open_ = np.flatnonzero((bound >= floor) & (ids != own))
    order = open_[np.argsort(-bound[open_], kind="stable")]
    found, scores, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 64
    while at < len(order) and (len(found) < k or bound[order[at]] >= scores[-1]):
        some = order[at : at + step]
        found, scores = np.concatenate((found, ids[some])), np.concatenate((scores, products(x[some], q)))
        top = np.lexsort((found, -scores))[:k]
        found, scores = found[top], scores[top]
        at, step = at + len(some), 2 * step
    return found, scores, at


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where all sums stay below 2^53, else in 64-bit whole numbers."""
    if len(x) and x.shape[1] * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) < 2**53:
        return (x.astype(float) @ q.astype(float)).astype(np.int64)
    return x @ q


def unpacked(rows: pd.DataFrame, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and distances to the pivots of ``rows``, as matrices."""
    x = np.frombuffer(b"".join(rows["x"]), np.int64).reshape(len(rows), space.dim)
    return x, np.array(rows["d"].tolist(), float).reshape(len(rows), len(space.pivots))


def answers(pairs: DataFrame, queries: DataFrame, rows: DataFrame, space: Space, k: int) -> DataFrame:
    """``(query, of, id, score)``: the best ``k`` of each pair of blocks ``(qb, rb)`` for every query of it, ``of`` the
    query's number."""

    def meet(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query": [], "of": [], "id": [], "score": []}).astype(np.int64)
        (q, dq), (x, dx) = unpacked(asked, space), unpacked(held, space)
        ids, dx = held["id"].to_numpy(), np.ascontiguousarray(dx.T)
        out = []
        for i, (own, of, floor) in enumerate(zip(asked["id"], asked["idx"], asked["floor"], strict=True)):
            found, scores, _ = best(q[i], dq[i], own, floor, x, dx, ids, space, k)
            out.append(pd.DataFrame({"query": own, "of": of, "id": found, "score": scores}))
        return pd.concat(out)

    asked = queries.select("id", "idx", "floor", "x", "d", F.col("block").alias("qb")).join(pairs, "qb")
    held = rows.select("id", "x", "d", F.col("block").alias("rb")).join(pairs, "rb")
    return asked.groupBy("qb", "rb").cogroup(held.groupBy("qb", "rb")).applyInPandas(meet, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of every query, with their ranks."""
    order = Window.partitionBy("of").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def apart(lo: Column, hi: Column, their_lo: Column, their_hi: Column) -> Column:
    """Lower bound on the distance of any two rows of two blocks: the widest gap between their distances to a pivot."""
    gaps = [F.array_max(F.zip_with(a, b, lambda x, y: x - y)) for a, b in ((lo, their_hi), (their_lo, hi))]
    return F.greatest(*gaps, F.lit(0.0))


def top_products(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", scale: int = 256, pivots: int = 32, sample: int = 1024, query_block: int = 1024, row_block: int = 4096) -> DataFrame:
    """``(query_id, rank, <key>, score)``: for each of ``queries`` the ``k`` rows of ``vectors`` with the greatest inner
    products of ``floor(scale * x)``, equal ones by their ids."""

    def clean(df: DataFrame) -> DataFrame:
        valid = df.select(F.col(f"`{key}`").cast("long").alias("id"), whole_numbers(F.col(f"`{column}`"), scale).alias("v"))
        return valid.where("id IS NOT NULL AND v IS NOT NULL").distinct()

    held = common.materialize(clean(vectors), "vectors")
    asked = common.materialize(clean(queries), "queries")
    space = space_of(held.unionByName(asked), pivots, sample)
    if not len(space.pivots) or not space.dim:
        return held.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(key), F.lit(0).cast("long").alias("score")).where("false")
    rows = in_blocks(with_distances(held, space, False), row_block, "rows")
    asked = in_blocks(with_distances(asked, space, True), query_block, "asked")
    # every block of queries and the blocks where its queries' cells begin
    begins = rows.groupBy("cell").agg(F.min("block").alias("rb"))  # one row a pivot
    home = common.materialize(asked.select(F.col("block").alias("qb"), "cell").distinct().join(F.broadcast(begins), "cell").select("qb", "rb").distinct(), "home")
    first = common.materialize(answers(home, asked.withColumn("floor", F.lit(float("-inf"))), rows, space, k), "found")
    known = ranked(first, k).groupBy("of").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
    floored = common.materialize(asked.join(known.select(F.col("of").alias("idx"), F.col("least").cast("double").alias("floor")), "idx", "left").fillna(float("-inf"), ["floor"]), "floored")
    # all other pairs of blocks that can hold an answer
    n = (rows.agg(F.max("block")).first()[0] or 0) + 1
    squared = F.col("own") + F.lit(space.r2) - 2 * F.col("floor") + F.lit(2 * SLACK * space.r2 + 2)
    theirs = reach(floored, len(space.pivots), F.max(squared).alias("farthest")).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    ours = reach(rows, len(space.pivots)).select(F.col("block").alias("rb"), F.col("lo").alias("rlo"), F.col("hi").alias("rhi"))
    gap = apart(F.col("lo"), F.col("hi"), F.col("rlo"), F.col("rhi"))
    pairs = theirs.join(ours, "rb").where(gap * gap <= F.col("farthest")).select(F.col("block").alias("qb"), "rb")
    pairs = common.materialize(pairs.join(home, ["qb", "rb"], "left_anti"), "pairs")
    found = first.unionByName(answers(pairs, floored, rows, space, k))
    return ranked(found, k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias(key), "score")
