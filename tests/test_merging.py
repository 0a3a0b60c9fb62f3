"""Merging, tags and evidence without gathering a key's rows."""

import pytest
from pyspark.sql import functions as F

from pelagos.operators import dedup, filters, score

FINDING = "ord long, tool string, severity string, type string, file string, function string, line int, message string, confidence double"


def test_harmonic_numbers(spark):
    rows = spark.range(0, 400).select("id", filters.harmonic(F.col("id")).alias("h")).collect()
    assert all(r.h == pytest.approx(sum(1 / i for i in range(1, r.id + 1)), abs=1e-11) for r in rows)


def test_diminishing_per_key_is_that_of_the_gathered_list(spark):
    rows = [(k, w) for k in range(30) for w in [0.02] * (k % 7) + [0.01] * (k % 11) + [0.001] * (k * 3)] + [(99, 0.5)] * 40
    df = spark.createDataFrame(rows, "k int, w double")
    got = {r.k: r.evidence for r in filters.diminishing_per(df, ["k"], "w").collect()}
    want = {r.k: r.e for r in df.groupBy("k").agg(filters.diminishing(F.collect_list("w")).alias("e")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert got[99] == 0.95


def test_merged_groups_keep_what_each_tool_said_first(spark):
    rows = [(3, "b", "High", "reentrancy", "f", "g", 11, "late", 0.5), (1, "a", "Low", "reentrancy", "f", "g", 12, "first", 0.5), (2, "a", "Low", "reentrancy", "f", "g", 13, "again", 0.5), (4, "a", "Low", "timestamp", None, None, 13, None, None)]
    df = spark.createDataFrame(rows, FINDING)
    got = {tuple(r.tools): r.evidence for r in dedup.merged_with_evidence(df).collect()}
    assert got == {("a", "b"): ["first", "late"], ("a",): [None]}
    assert tuple(dedup.merge_statistics(dedup.semantic(df)).first()) == (4, 2, 2, 0.5, 1)
    assert tuple(dedup.merge_statistics(dedup.semantic(df.limit(0))).first()) == (0, 0, 0, 0.0, 0)


def test_tags(spark):
    df = spark.createDataFrame([(["slither", "gptscan"], 0.9), (["gptscan"], 0.5), (["mythril", "x"], 0.5), (["x"], 0.1)], "tools array<string>, c double")
    assert [(r.tag, round(r.confidence, 3)) for r in score.tagged(df).collect()] == [("cross", 1.0), ("model", 0.5), ("static", 0.5), ("static", 0.1)]
