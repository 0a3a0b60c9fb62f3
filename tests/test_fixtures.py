"""Small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from pelagos import schema
from pelagos.functions import scalars as S
from pelagos.operators import dedup, evaluate, filters, graph, joins, normalize, rank, score, storage, text, vectors

FINDING = "ord long, tool string, severity string, type string, file string, function string, line int, message string, confidence double"


def findings(spark, rows):
    full = [(i, *r, *[None] * (8 - len(r))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, FINDING)


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_two_tools_at_one_place_are_one_group(spark):
    f = findings(spark, [("slither", "High", "reentrancy-eth", "C.sol", "withdraw", 27, "a"), ("aderyn", "High", "reentrancy", "C.sol", "withdraw", 25, "b")])
    got = dedup.semantic(f).collect()
    assert len(got) == 1 and got[0].tools == ["aderyn", "slither"]
    assert got[0].confidence == pytest.approx(0.962, abs=6e-4)


@pytest.mark.parametrize(("tools", "want"), [(["slither"], 0.85), (["slither", "slither"], 0.978), (["slither", "aderyn", "mythril"], 0.99)])
def test_noisy_or(spark, tools, want):
    f = findings(spark, [(t, "High", "arithmetic", "C.sol", "f", 1, "m") for t in tools])
    row = dedup.semantic(f).first()
    assert row.confidence == pytest.approx(want) and row.tool_count == len(set(tools))


def test_greedy_and_components_differ_as_documented(spark):
    f = findings(spark, [("t", "High", "arithmetic", "C.sol", "", n, "m") for n in (10, 20, 15)])
    greedy = {r.ord: r.group for r in dedup.greedy(f).collect()}
    assert greedy == {0: 0, 1: 1, 2: 0}
    joined = {r.ord: r.group for r in dedup.components(dedup.near_pairs(f), f).collect()}
    assert joined == {0: 0, 1: 0, 2: 0}


def test_messages_join_types(spark):
    f = findings(spark, [("a", "High", "arithmetic", "C.sol", "", 10, "owner can drain all funds"), ("b", "High", "tx-origin", "C.sol", "", 12, "Owner can drain all fund"), ("c", "High", "timestamp", "C.sol", "", 12, "something else")])
    assert [tuple(r) for r in dedup.near_pairs(f).collect()] == [(0, 1)]


@pytest.mark.parametrize(("line", "want"), [("5-10", 5), ("L5", 5), ("-3", 0), (None, 0), ("x", 0), ("12", 12)])
def test_safe_line(spark, line, want):
    assert one(spark, S.safe_line(F.col("v")), v=line) == want


@pytest.mark.parametrize(("value", "want"), [("95", 1.0), ("-1", 0.0), ("high", 0.9), ("abc", 0.7), ("0.25", 0.25), (None, None)])
def test_safe_confidence(spark, value, want):
    assert one(spark, S.safe_confidence(F.col("v")), v=value) == want


@pytest.mark.parametrize(("kind", "tools", "want"), [("reentrancy-eth", ["slither"], (0.6, "medium")), ("reentrancy-eth", ["slither", "aderyn"], (0.9, "high")), ("other", ["slither"], (0.85, "high"))])
def test_calibrated_confidence(spark, kind, tools, want):
    g = spark.createDataFrame([(kind, tools)], "type string, tools array<string>")
    row = score.calibrate(g).first()
    assert (row.score, row.level) == want


def test_security_score(spark):
    row = score.security_score(findings(spark, [("t", "critical", "x", "C.sol", "f", 1, "m")]), ["file"]).first()
    assert (row.score, row.grade, row.penalty) == (60, "D", 40.0)


def test_messages_with_moved_lines_have_one_fingerprint(spark):
    prints = spark.createDataFrame([("X (line 42)",), ("X (line 57)",), ("X  (Ln: 3:7)",), ("Y",)], "m string").select(
        S.fingerprint(F.lit("r"), F.lit("./a//b.sol"), F.lit(" f  g "), F.col("m")).alias("p")
    )
    got = [r.p for r in prints.collect()]
    assert got[0] == got[1] == got[2] != got[3]
    assert one(spark, S.normalize_path(F.lit(".\\a\\./b//c.sol"))) == "a/b/c.sol" and one(spark, S.normalize_path(F.lit("/x//y"))) == "/x/y"


def test_diff(spark):
    side = lambda *x: spark.createDataFrame([(v,) for v in x], "fingerprint string")
    assert {tuple(r) for r in joins.diff(side("a", "b", "b"), side("b", "c")).collect()} == {("a", "new"), ("b", "known"), ("c", "fixed")}


def test_ranking_metrics(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1), (2, 1, 1)], "q int, rk int, rel int")
    got = {r.q: r for r in evaluate.ranking(rows, "q", "rk", "rel").collect()}
    assert got[1].dcg == pytest.approx(1.130930) and got[1].ndcg == pytest.approx(0.693426)
    assert (got[1].ap + got[2].ap) / 2 == pytest.approx(0.791667, abs=1e-6) and got[1].rr == 0.5


def test_statistics(spark):
    low, high = S.wilson(F.lit(9), F.lit(11))
    assert spark.range(1).select(low, high).first()[:] == (0.5230, 0.9486)
    rows = spark.createDataFrame([(True, False)] * 3 + [(False, True)] + [(True, True)] * 5, "a boolean, b boolean")
    row = evaluate.mcnemar(rows, F.col("a"), F.col("b")).first()
    assert (row.b, row.c, row.p_value) == (3, 1, 0.625)
    many = spark.createDataFrame([(True, False)] * 30 + [(False, True)] * 10, "a boolean, b boolean")
    assert evaluate.mcnemar(many, F.col("a"), F.col("b")).first().p_value == pytest.approx(0.002663, abs=1e-6)


def test_votes(spark):
    f = findings(spark, [("slither", "High", "x", "a.sol", "f", 1, "m", 0.5), ("aderyn", "High", "x", "b.sol", "f", 2, "m", 0.9), ("aderyn", "High", "x", "b.sol", "f", 3, "m", 0.1)])
    row = dedup.votes(f, 3, "majority").first()
    assert row.votes == 2 and row.passes and row.confidence == pytest.approx(0.8)
    assert not dedup.votes(f, 3, "unanimous").first().passes


def test_one_to_one_match(spark):
    pairs = spark.createDataFrame([("c", 1, 10), ("c", 1, 11), ("c", 2, 10), ("c", 3, 12)], "f string, a long, b long")
    assert {tuple(r) for r in joins.one_to_one(pairs, ["f"], "a", "b").collect()} == {("c", 1, 10), ("c", 3, 12)}


def test_graph_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    s = spark.createDataFrame([("a",)], "start string")
    assert {r.node for r in graph.reachable(e, s).collect()} == {"a", "b", "c"}
    paths = graph.simple_paths(e, s, spark.createDataFrame([("c",)], "sink string")).collect()
    assert [r.path for r in paths] == [["a", "b", "c"]]
    t = graph.taint(e, spark.createDataFrame([("a", "x")], "node string, label string"), spark.createDataFrame([("c",)], "node string"))
    assert {tuple(r) for r in t.collect()} == {("a", "x", 0), ("b", "x", 1)}


def test_rounding_is_half_even(spark):
    assert one(spark, F.bround(F.lit(0.125), 2)) == 0.12 and one(spark, F.bround(F.lit(2.5), 0)) == 2


def test_exact_collapse_keeps_order_of_arrival(spark):
    f = findings(spark, [("zeta", "High", "x", "C.sol", "f", 1, "m"), ("alpha", "High", "x", "C.sol", "f", 1, "m"), ("zeta", "High", "x", "C.sol", "f", 1, "m")])
    row = dedup.exact(f, ["type", "file", "line"]).first()
    assert row.tools == ["zeta", "alpha"] and row.collapsed == 2


def test_missing_confidence_is_kept(spark):
    f = findings(spark, [("t", "High", "x", "C.sol", "f", 1, "m", None), ("t", "High", "x", "C.sol", "f", 1, "m", 0.2)])
    assert filters.min_confidence(f, 0.5).count() == 1 and filters.min_confidence(f, 0).count() == 2


def test_normalize_both_vocabularies(spark):
    rows = spark.createDataFrame(
        [("t", '{"type":"A","severity":"HIGH!","location":{"file":"x","line":"7","function":"f"},"message":"m","confidence":"low"}'), ("t", '{"check":"B","impact":"crit","lineno":9,"filename":"y","description":"d"}'), ("t", "not json"), ("t", None)],
        "tool string, raw string",
    )
    got = normalize.normalize(normalize.parse(rows)).orderBy("type").collect()
    known = [r for r in got if r.type != "unknown"]
    assert [(r.type, r.severity, r.file, r.line, r.confidence) for r in known] == [("a", "high", "x", 7, 0.5), ("b", "critical", "y", 9, 1.0)]


def test_cvss(spark):
    v = {k: F.lit(x) for k, x in zip(("av", "ac", "pr", "ui", "c", "i", "a"), ("N", "L", "N", "N", "H", "H", "H"), strict=True)}
    assert one(spark, S.cvss_base(v)) == 9.9
    none = {**v, "c": F.lit("N"), "i": F.lit("N"), "a": F.lit("N")}
    assert one(spark, S.cvss_base(none)) == 0.0


def test_folds(spark):
    rows = spark.createDataFrame([("k", i, x) for i, x in enumerate([True, True, False, False, False, False, False, False, False, True])], "k string, o long, up boolean")
    x = 0.0
    for up in [True, True] + [False] * 7 + [True]:
        x = min(0.2, max(-0.3, x + (0.02 if up else -0.05)))
    assert score.clamped_walk(rows, "k", "up", "o").first().adjustment == pytest.approx(x)
    m = 0.5
    for up in [True, True] + [False] * 7 + [True]:
        m = 0.7 * m + 0.3 * up
    assert score.ewma(rows.withColumn("v", F.col("up").cast("int")), "k", "v", "o").first().ewma == pytest.approx(m)


def test_scan_with_a_guard_nearby(spark):
    d = spark.createDataFrame([(1, "call.value()\nrequire(ok)\n\n\n\ncall.value()")], "doc_id long, text string")
    got = text.scan(text.lines_of(d), [("call", r"call\.value", r"require\(")], window=1)
    assert [tuple(r) for r in got.collect()] == [(1, 6, "call")]


def test_vector_pairs_in_tiles(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 8))
    rows = spark.createDataFrame([(i, 0, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, label int, embedding array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.6}
    assert {(r.a, r.b) for r in vectors.pairs_within(rows, "label", 0.6, tile=16).collect()} == want


def test_latest_and_top(spark):
    v = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, n int, s string")
    assert {tuple(r) for r in storage.latest(v, ["k"], F.col("n")).collect()} == {("a", 3, "y"), ("b", 2, "z")}
    assert rank.top_per(v, ["k"], [F.desc("n")], 1).count() == 2


def test_empty_inputs(spark):
    f = spark.createDataFrame([], FINDING)
    assert dedup.semantic(f).count() == dedup.near_pairs(f).count() == dedup.greedy(f).count() == score.security_score(f, ["file"]).count() == 0
    assert {r.n for r in score.risk_matrix(f).collect()} == {0}
    assert dedup.components(dedup.near_pairs(f), f).count() == score.consensus(f).count() == filters.gate(f, ["file"], "high", schema.SEVERITY_ORDER).count() == 0


def test_fingerprints_leave_line_references_out(spark):
    """Baselines that were stored earlier hold fingerprints made with these patterns."""
    from pelagos import schema

    styles = ["at line 12", "ln: 4", "row #7", "columns 3 - 9", "offset=5", "file.sol:10:4", "issue #33", "see L90", "L7 and L8"]
    rows = spark.createDataFrame([(x,) for x in [*styles, "SWC-107 costs 5", "v1.2:3"]], "m string")
    left = [r.x for r in rows.select(F.regexp_replace("m", schema.LINE_REFERENCE, "").alias("x")).collect()]
    assert left[:9] == ["at ", "", "", "", "", "file.sol:10:4", "issue ", "see ", " and "]
    assert left[9:] == ["SWC-107 costs 5", "v1.2:3"]
