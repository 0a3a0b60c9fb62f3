"""Tables that are appended to, versioned, expired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def latest(versions: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Updates by appending: the last version of each key is the row."""
    rest = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("v")).select(*keys, *[f"v.{c}" for c in rest])


def retain(parents: DataFrame, children: DataFrame, key: str, created: str, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """Parents of the last ``days`` and the children that are theirs."""
    kept = parents.where(F.col(created) >= now - F.make_dt_interval(F.lit(days)))
    return kept, children.join(kept.select(key), key, "left_semi")


def unexpired(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires") > now)


def evict(cache: DataFrame, keep: int, created: str = "created", key: str = "key") -> DataFrame:
    """The ``keep`` newest entries; a sort-limit, so tasks keep their own newest only."""
    return cache.orderBy(F.desc(created), key).limit(keep)


def newest_per(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= k)
