"""Readers and sinks by round trip; streams against the same rows as a batch."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pelagos.operators import normalize
from pelagos.sinks import writers
from pelagos.sources import readers, tools
from pelagos.streaming import events as streams

FINDING = "ord long, tool string, severity string, type string, file string, function string, line int, message string, confidence double"


@pytest.fixture(scope="module")
def findings(spark):
    rows = [(0, "slither", "high", "reentrancy-eth", "a.sol", "f", 3, "m (line 3)", 0.9), (1, "aderyn", "low", "timestamp", "b.sol", "g", 0, "n", None), (2, "aderyn", "high", "timestamp", "b.sol", "g", 4, "o", 0.5)]
    return spark.createDataFrame(rows, FINDING)


@pytest.mark.parametrize("kind", sorted(writers.WRITERS))
def test_sinks_write(spark, findings, tmp_path, kind):
    path = str(tmp_path / kind)
    writers.export(findings, kind, path)
    if kind in ("sarif", "sonar", "jsonl"):
        assert spark.read.json(path).count() == 3
    elif kind == "csv":
        assert spark.read.option("header", True).csv(path).count() == 3
    elif kind == "checkmarx":
        assert spark.read.format("xml").option("rowTag", "Query").load(path).count() == 3
    elif kind == "baseline":
        assert spark.read.parquet(path).count() == 3


def test_sink_rows(findings):
    rules = {r.rule_id: r.level for r in writers.sarif_rules(findings).collect()}
    assert rules == {"reentrancy-eth": "error", "timestamp": "error"}
    assert {r.start_line for r in writers.sarif_results(findings).collect()} == {3, 1, 4}
    lines = [r.value for r in writers.annotations(findings, 2).collect()]
    assert len(lines) == 3 and lines[-1] == "1 further findings"
    assert [r.value for r in writers.markdown_summary(findings).collect()] == ["| high | 2 |", "| low | 1 |"]


def test_chat_styles(spark):
    rows = spark.createDataFrame([("do", "this", "done")], "instruction string, context string, response string")
    assert json.loads(writers.chat(rows, "alpaca").first().value) == {"instruction": "do", "input": "this", "output": "done"}
    assert json.loads(writers.chat(rows, "chatml").first().value)["messages"][0] == {"role": "user", "content": "do\n\nthis"}
    assert json.loads(writers.chat(rows, "sharegpt").first().value)["conversations"][1] == {"from": "gpt", "value": "done"}
    samples = spark.createDataFrame([("m", {"b": "2", "a": "1"}, 3.0)], "name string, labels map<string,string>, value double")
    assert writers.prometheus(samples).first().value == 'm{a="1",b="2"} 3.0'
    assert json.loads(spark.range(1).select(writers.badge(F.lit(87), F.lit("B")).alias("x")).first().x)["message"] == "87/100 (B)"


def test_result_documents_of_all_shapes(spark, tmp_path):
    finding = {"type": "x", "severity": "High", "location": {"file": "a", "line": 3}, "confidence": 0.5}
    (tmp_path / "a.json").write_text(json.dumps({"results": [{"tool": "slither", "contract": "c", "findings": [finding, finding]}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"tool": "aderyn", "findings": [finding]}))
    rows = normalize.normalize(normalize.flatten(readers.results(spark, str(tmp_path)))).collect()
    assert sorted((r.tool, r.line, r.confidence) for r in rows) == [("aderyn", 3, 0.5), ("slither", 3, 0.5), ("slither", 3, 0.5)]


def test_other_readers(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/x.csv").write_text("loc,length,bug type,approach\n5,2,re,code\n,1,re,code\nx,1,re,code\n0,1,re,code\n")
    assert [tuple(r) for r in readers.bug_log(spark, str(tmp_path / "log")).collect()] == [(5, 2, "re", "code")]
    (tmp_path / "set/reentrancy").mkdir(parents=True)
    (tmp_path / "set/reentrancy/a.sol").write_text("contract A {}\n")
    files = readers.labelled_folders(spark, str(tmp_path / "set"))
    assert [(r.category, r.text) for r in files.collect()] == [("reentrancy", "contract A {}\n")]
    (tmp_path / "m.json").write_text(json.dumps([{"name": "a.sol", "path": "reentrancy/a.sol", "vulnerabilities": [{"category": "re", "lines": [1, 2]}]}, {"name": "gone", "path": "gone.sol"}]))
    assert [(r.name, r.lines) for r in readers.manifest(spark, str(tmp_path / "m.json"), files).collect()] == [("a.sol", [1, 2])]
    (tmp_path / "out/slither").mkdir(parents=True)
    (tmp_path / "out/slither/c.json").write_text(json.dumps({"results": {"detectors": [{"check": "tx-origin", "impact": "High", "description": "d", "confidence": "Medium"}]}}))
    (tmp_path / "out/hardhat").mkdir()
    (tmp_path / "out/hardhat/d.txt").write_text("ok\na/b.sol:3:4: Warning: Unused variable\n")
    rows = {r.tool: r for r in tools.collect(readers.tool_outputs(spark, str(tmp_path / "out"))).collect()}
    assert (rows["slither"].type, rows["slither"].severity, rows["slither"].confidence, rows["slither"].swc_id) == ("tx-origin", "High", 0.75, "SWC-115")
    assert (rows["hardhat"].type, rows["hardhat"].file, rows["hardhat"].line) == ("unused_variable", "a/b.sol", 3)
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n')
    assert readers.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").where("_corrupt_record is null").collect()[0].a == 1
    (tmp_path / "i.json").write_text(json.dumps({"incidents": [{"id": "1", "name": "n", "amount_lost_usd": 5}]}))
    assert readers.incidents(spark, str(tmp_path / "i.json")).first().amount_lost_usd == 5


@pytest.mark.parametrize(("times", "want"), [([0, 1, 2, 3, 11], [True, True, True, False, True])])
def test_rate_limit(spark, times, want):
    e = spark.createDataFrame([("k", i, t) for i, t in enumerate(times)], "k string, event_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = streams.rate_limit(e, "k", "ts", 3, 10.0).orderBy("event_id").collect()
    assert [r.accepted for r in got] == want


def test_debounce(spark):
    e = spark.createDataFrame([("k", i, t) for i, t in enumerate([0.0, 1.5, 3.0])], "k string, event_id long, s double").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.accepted for r in streams.debounce(e, "k", "ts", 2.0).orderBy("event_id").collect()] == [True, False, True]


def run(query, name, spark, mode="append"):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_match_batches(spark, tmp_path):
    rows = [{"event_id": i, "k": f"k{i % 3}", "ts": f"2024-01-0{1 + i // 20}T{i % 20:02d}:00:00Z"} for i in range(60)]
    (tmp_path / "in").mkdir()
    for part in range(3):
        file = tmp_path / f"in/{part}.json"
        file.write_text("\n".join(json.dumps(r) for r in rows[part * 20 : part * 20 + 20]))
        os.utime(file, (1e9 + part, 1e9 + part))  # files are taken in order of their time
    shape = "event_id long, k string, ts timestamp"
    batch = spark.read.schema(shape).json(str(tmp_path / "in"))
    stream = lambda: streams.watch(spark, str(tmp_path / "in"), shape, 1)
    counts = run(streams.tumbling(stream(), "ts", "1 day", ["k"]), "tumbled", spark, "complete")
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in streams.tumbling(batch, "ts", "1 day", ["k"]).collect()}
    limited = run(streams.rate_limit(stream(), "k", "ts", 1, 7200.0), "limited", spark)
    want = {(r.event_id, r.accepted) for r in streams.rate_limit(batch, "k", "ts", 1, 7200.0).collect()}
    assert limited.count() == 60 and {(r.event_id, r.accepted) for r in limited.collect()} == want
    once = run(streams.once_within(stream(), ["k"], "ts", "30 days"), "once", spark)
    assert once.count() == 3
    q = streams.upsert(stream(), str(tmp_path / "up"), str(tmp_path / "cp"), ["k"], "event_id").trigger(availableNow=True).start()
    q.awaitTermination(120)
    from pelagos.operators import storage

    assert {(r.k, r.event_id) for r in storage.latest(spark.read.parquet(str(tmp_path / "up")), ["k"], F.col("batch")).collect()} == {("k0", 57), ("k1", 58), ("k2", 59)}


@pytest.mark.parametrize("shape", sorted(tools.SHAPES))
def test_broken_outputs_give_no_rows(spark, shape):
    rows = spark.createDataFrame([(1, "c", None), (2, "c", ""), (3, "c", "{"), (4, "c", "[]"), (5, "c", "{}")], "ord long, contract string, body string")
    # A body that is one object is a list of one where a list is wanted.
    lone = (tools.SHAPES[shape].document or "").startswith("array")
    assert tools.normalize(rows.where("ord < 5") if lone else rows, shape).collect() == []
