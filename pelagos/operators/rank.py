"""Ordering and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per(rows: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their rank. Spark keeps k rows per key and task before the shuffle (the limit on
    row_number is pushed below it), so a hot key sends k rows per task."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def first_rows(rows: DataFrame, order: list[Column], k: int, name: str = "place") -> DataFrame:
    """The first ``k`` rows of all, numbered; each task keeps ``k`` of its own before they meet."""
    return rows.orderBy(*order).limit(k).withColumn(name, F.row_number().over(Window.orderBy(*order)))  # k rows


def enhanced_order(rows: DataFrame, rank: Column) -> list[Column]:
    """Most severe first, then most confident, then first come."""
    return [rank.desc(), F.col("confidence").desc(), F.col("ord").asc()]
