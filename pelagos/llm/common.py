"""Helpers shared by the corpus operators: inputs, shared tables, ordered indexes, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Words are maximal runs of anything but the ASCII white space characters (Java and RE2 syntax alike).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share, as the session names it. Where none is named: a temporary one if all runs on
    one machine, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pelagos-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of these files, never a recomputation
    from the source. The table is read with the schema it was written with.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pelagos/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete every table that ``materialize`` has left in the shared folder; for when no result is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/pelagos")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_or_shuffled(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` (narrow and materialized) marked for broadcast if it has at most ``most`` rows; else as it is, for a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one, ``row``, so that their names meet no others."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def unpacked(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` out of ``row``, those in ``changed`` replaced."""
    return [changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once although the body uses it again and again."""
    return F.transform(F.array(value), body)[0]


def tuned(df: DataFrame, by: list, factor: int = 1) -> DataFrame:
    """Hash-partition by ``by`` into the session's number of shuffle partitions (times ``factor``)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, n * factor), *by)


def ordered_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """Add ``name``: the row's place (from 0) in the order of ``order``, without sorting in one task.

    Rows are range-partitioned and sorted where they land; only the number of rows of each partition
    is summed in one place.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own, part = f"{name}__own", f"{name}__part"
    placed = materialize(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(own, F.monotonically_increasing_id()),
        "ordered",
    ).withColumn(part, F.shiftright(own, 33))
    sums = placed.groupBy(part).agg(F.count("*").alias("__n"))
    before = sums.select(
        part, (F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before")
    )
    return (
        placed.join(before, part)
        .withColumn(name, F.col("__before") + F.col(own).bitwiseAND(F.lit((1 << 33) - 1)))
        .drop(own, part, "__before")
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): one row ``(node, component)`` per node with a link.

    ``component`` is the smallest node reachable. Large-star and small-star rounds alternate; every round
    is two hash aggregations (combined before the shuffle) and equi-joins whose small side has one row per
    node, so a node with very many links is split by adaptive skew handling. Each round is written to the
    shared folder; only a count and a checksum come to the driver. Empty input gives no rows.
    """
    live = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    for _ in range(max_rounds):
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        live = materialize(small, "edges")
        now = live.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = live.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = live.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)


def long_schema(**kinds: str) -> T.StructType:
    """A schema from ``name='long'`` pairs, in order."""
    return T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in kinds.items()))
