import os

from pyspark.sql import functions as F

from pelagos.llm import common


def test_ordered_index_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(None,), ("b",), ("a",), ("b",), ("ä",), ("Z",)], "source string").repartition(3)
    got = sorted((r.idx, r.source) for r in common.ordered_index(df, [F.col("source").asc_nulls_last()]).collect())
    assert [s for _, s in got] == ["Z", "a", "b", "b", "ä", None] and [i for i, _ in got] == list(range(6))


def test_tables_can_be_dropped(spark):
    kept = common.materialize(spark.range(5), "x")
    assert kept.count() == 5
    files = [f.removeprefix("file:").replace("///", "/") for f in kept.inputFiles()]
    assert files and all(map(os.path.exists, files))
    common.drop_tables(spark)
    assert not any(map(os.path.exists, files))


def test_small_tables_only_are_marked(spark):
    assert common.small_or_shuffled(spark.range(3), 2).count() == 3
