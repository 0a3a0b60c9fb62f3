"""Sessions with timers: a stream against the batch of the same rows, limits of nested JSON, versions."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from pelagos.operators import bounded, code
from pelagos.streaming import sessions

SCHEMA = "event_id long, client string, ts timestamp, kind string"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def events():
    random.seed(6)
    rows, t = [], 1_700_000_000
    for i in range(400):
        t += random.choice([0, 1, 5, 40])
        client = random.choice("abcdef") if i < 300 else random.choice("ab")
        rows.append((i, client, t, random.choices(["step", "error", "done"], [8, 2, 1])[0]))
    return rows


def streamed(spark, rows, folder, build, files=4):
    """The rows in files, a trigger a file, through the streaming form."""
    source, size = folder / "in", -(-len(rows) // files)
    source.mkdir()
    for n in range(files):
        part = rows[n * size : (n + 1) * size]
        file = source / f"{n}.json"
        file.write_text("\n".join(json.dumps({"event_id": i, "client": c, "ts": t, "kind": k}) for i, c, t, k in part))
        os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))  # files are taken by their times
    raw = spark.readStream.schema("event_id long, client string, ts long, kind string").option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(source))
    stream = build(raw.withColumn("ts", F.timestamp_seconds("ts")))
    query = stream.writeStream.format("memory").queryName("ended").outputMode("append").option("checkpointLocation", str(folder / "state")).start()
    query.processAllAvailable()
    query.stop()
    return spark.table("ended")


def key(df):
    return sorted(map(tuple, df.collect()))


def test_a_silent_session_times_out_in_a_stream(rocks, tmp_path):
    rows = events()
    run = lambda df: sessions.ended(df, "client", "ts", "kind", "event_id", {"done": "completed"}, 120, "error")
    batch = rocks.createDataFrame(rows, "event_id long, client string, ts long, kind string").withColumn("ts", F.timestamp_seconds("ts"))
    want = key(run(batch))
    assert {r[-1] for r in want} == {"completed", "timed_out"} and {r[0] for r in want} >= set("cdef")
    assert key(streamed(rocks, rows, tmp_path, run)) == want


def test_timers_are_reset_by_new_rows(rocks, tmp_path):
    rows = [(0, "a", 1000, "step"), (1, "b", 1000, "step"), (2, "a", 1050, "step"), (3, "b", 1050, "done"), (4, "a", 1100, "step"), (5, "c", 1190, "step"), (6, "c", 1300, "step")]
    run = lambda df: sessions.ended(df, "client", "ts", "kind", "event_id", {"done": "completed"}, 100)
    got = {(r.session, r.steps, r.state) for r in streamed(rocks, rows, tmp_path, run, files=7).collect()}
    assert got == {("b", 2, "completed"), ("a", 3, "timed_out"), ("c", 1, "timed_out")}


def test_sessions_of_odd_batches(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sessions.ended(empty, "client", "ts", "kind", "event_id", {"done": "completed"}, 10).count() == 0
    rows = spark.createDataFrame([(0, "a", 10, "done"), (1, "a", 10, "done"), (2, None, 10, "step"), (3, None, 100, "step")], "event_id long, client string, ts long, kind string").withColumn("ts", F.timestamp_seconds("ts"))
    got = sorted(((r.session, r.steps, r.state) for r in sessions.ended(rows, "client", "ts", "kind", "event_id", {"done": "completed"}, 10).collect()), key=repr)
    assert got == [("a", 1, "completed"), ("a", 1, "completed"), (None, 1, "timed_out")]
    assert [(r.session, r.steps) for r in sessions.silent(rows.where("client is null"), "client", "ts", "event_id", 10).collect()] == [(None, 1)]


def nested(depth):
    return "[" * depth + "1" + "]" * depth


BODIES = {
    1: ('{"a": [1, {"b": "x"}]}', None), 2: (nested(8), None), 3: (nested(9), "depth"), 4: (json.dumps(list(range(100))), None), 5: (json.dumps(list(range(101))), "items"),
    6: (json.dumps({str(i): i for i in range(101)}), "keys"), 7: (json.dumps({"t": "x" * 5000}), None), 8: (json.dumps({"t": ["x" * 5001]}), "text"), 9: ("{", "json"), 10: (None, "json"),
    11: (json.dumps({"k" * 121: 1}), "key"), 12: (json.dumps({"a": {" ": 1}}), "key"), 13: (json.dumps({"a": "x‮y"}), "text"), 14: ("null", None), 15: ("3.5", None), 16: ('"' + "y" * 5001 + '"', "text"), 17: ("", "json"),
}


def test_a_body_beyond_a_limit_is_rejected_whole(spark):
    docs = spark.createDataFrame([(i, b, i) for i, (b, _) in BODIES.items()], "id long, body string, kind long")
    reasons = {}
    for r in bounded.violations(docs).collect():
        reasons.setdefault(r.id, set()).add(r.reason)
    assert reasons == {i: {why} for i, (_, why) in BODIES.items() if why}
    kept = bounded.within_limits(docs)
    assert kept.columns == docs.columns and {r.id for r in kept.collect()} == {i for i, (_, why) in BODIES.items() if not why}
    assert {r.path for r in bounded.violations(docs.where("id = 8")).collect()} == {"$.t[0]"}
    tight = bounded.within_limits(docs.where("id in (1, 4)"), items=1)
    assert tight.count() == 0


def test_versions_and_ranges(spark):
    keys = {r.v: r.k for r in spark.createDataFrame([(v,) for v in ("1.2.3", "^1.2", "v10", ">=0.9.12-beta", "x", "")], "v string").select("v", code.version_key(F.col("v")).alias("k")).collect()}
    assert keys["1.2.3"] == 1_000_002_000_003 and keys["^1.2"] == 1_000_002_000_000 and keys["v10"] == 10_000_000_000_000 and keys[">=0.9.12-beta"] == 9_000_012 and keys["x"] is None and keys[""] is None
    deps = spark.createDataFrame([("p", v) for v in ("1.9.9", "1.10.0", "2.0.0", "2.0.1", None)] + [("q", "1.0.0")], "package string, version string")
    ranges = spark.createDataFrame([("p", "1.10.0", "2.0.0", "A"), ("p", None, "1.10.0", "B"), ("p", "2.0.1", None, "C"), ("r", None, None, "D")], "package string, introduced string, fixed string, advisory string")
    assert {(r.version, r.advisory) for r in code.advised(deps, ranges).collect()} == {("1.9.9", "B"), ("1.10.0", "A"), ("2.0.1", "C")}
    docs = spark.createDataFrame([(1, 'import "@a/b@1.2.3/X.sol"; // import "@a/c@1.0.0/Y.sol";\nimport {Z} from \'lib@4/Z.sol\'; import "./own.sol";')], "doc_id long, text string")
    assert {tuple(r)[1:] for r in code.versioned_imports(docs).collect()} == {("@a/b", "1.2.3"), ("lib", "4")}
