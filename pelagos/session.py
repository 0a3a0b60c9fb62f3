"""Spark sessions for local work; on a cluster, the session that is there is used as it is."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pelagos")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder that the session names; to one of our own only where none is named."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pelagos-"))


def spread(rows: DataFrame, key: str, most: int = 5_000) -> DataFrame:
    """``rows`` dealt by ``key`` to as many tasks as leave each about ``most`` of them.

    For narrow rows that grow once they are read: a scan has as many tasks as its files have megabytes, whatever is made of
    a row afterwards.
    """
    return rows.repartition(max(1, -(-rows.count() // most)), key)


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows`` marked so that a join sorts and merges them and never collects them to broadcast them.

    For rows that are unpacked from narrower ones: Spark's estimate is made from the files' size, too low by far, and is kept
    over a checkpoint.
    """
    return rows.hint("merge")


def few_or_shuffled(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (narrow, and quick to count) marked for broadcast if they are at most ``most``, else as by ``shuffled``."""
    return F.broadcast(rows) if rows.count() <= most else shuffled(rows)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if they can see that folder, and use one thread
    each for matrices, as a task has one core.

    On a cluster the package is installed or sent with --py-files; then the folder changes nothing that matters.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    environment.setdefault("OMP_NUM_THREADS", "1")
