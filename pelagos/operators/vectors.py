"""Vector search over ``(id, embedding)`` tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions import scalars as S


def unit(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors divided by their length; zero vectors stay zero."""
    length = S.norm(F.col(column))
    scaled = F.transform(column, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0))
    return vectors.withColumn(column, scaled)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", most_queries: int = 10_000) -> DataFrame:
    """``(query, key, similarity, rank)``: the ``k`` nearest rows of each stated query by cosine, exact.

    The queries are collected behind a check of their number and travel with the job as one matrix; each task gives
    its own k best per query, so what is shuffled is queries * k rows per task, never pairs.
    """
    stated = queries.select(key, "embedding").orderBy(key).limit(most_queries + 1).toPandas()
    if len(stated) > most_queries:
        raise ValueError(f"more than {most_queries} queries: search them in blocks")
    ids = stated[key].to_numpy()
    q = np.stack(stated["embedding"].to_numpy()).astype(np.float64) if len(stated) else np.zeros((0, 1))
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    def run(batches):
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            x = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
            own = batch[key].to_numpy()
            scores = np.round(q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T, 9)
            for i, row in enumerate(scores):
                row = np.where(own == ids[i], -np.inf, row)
                best = np.lexsort((own, -row))[: k + 1]
                best = best[np.isfinite(row[best])][:k]
                yield pd.DataFrame({"query": ids[i], key: own[best], "similarity": row[best]})

    found = vectors.select(key, "embedding").mapInPandas(run, f"query long, {key} long, similarity double")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pairs_within(vectors: DataFrame, by: str, least: float, key: str = "vec_id", tile: int = 512) -> DataFrame:
    """``(a, b, similarity)`` of rows of one ``by`` value with cosine of at least ``least``; blocks of rows are compared as
    matrices, and a value with many rows is dealt to many tasks as pairs of tiles."""
    sized = vectors.groupBy(by).count().select(by, F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64(key), F.col("tiles")).cast("int")
    with_tile = vectors.select(key, by, "embedding").join(sized, by).withColumn("own", own)
    sent = with_tile.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = sent.select(by, F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"), "own", key, "embedding")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        t1, t2 = rows["t1"].iloc[0], rows["t2"].iloc[0]
        left, right = np.flatnonzero(rows["own"] == t1), np.flatnonzero(rows["own"] == t2)
        s = np.round(x[left] @ x[right].T, 9)
        i, j = np.nonzero(s >= least)
        a, b = rows[key].to_numpy()[left[i]], rows[key].to_numpy()[right[j]]
        keep = a < b if t1 == t2 else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": s[i, j][keep]})

    return placed.groupBy(by, "t1", "t2").applyInPandas(compare, "a long, b long, similarity double")


def rerank(similarity: Column, quality: Column, cues: Column) -> Column:
    """Similarity with a share for quality and for cues, the latter at most 0.12."""
    return F.lit(0.78) * similarity + F.lit(0.22) * quality + F.least(cues, F.lit(0.12))
