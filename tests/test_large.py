"""What keeps queries within bounds on large tables: tasks by rows, one reading of a text, no broadcast of unknown size."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagos import catalog, session
from pelagos.operators import clusters, code, correlate, crossing, dedup, flows, graph, joins, lexer, verify, vindex
from pelagos.plans import views

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """12,000 parts, which one file of a few kilobytes holds."""
    path = str(tmp_path_factory.mktemp("many"))
    spark.range(12_000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{path}/part.parquet")
    return path


def test_contracts_are_dealt_to_tasks_by_their_number(spark, many):
    assert views.contracts(spark, many).rdd.getNumPartitions() == 3
    assert session.spread(spark.range(0), "id").rdd.getNumPartitions() == 1


def test_rules_read_every_line_once(spark, many):
    hits = plan(code.detect(views.contracts(spark, many)))
    assert len(re.findall("MapInArrow", hits)) == 1
    assert "Join" not in hits


def test_calls_read_every_function_once(spark, many):
    edges = plan(code.calls(lexer.functions(views.contracts(spark, many))))
    assert len(re.findall("MapInArrow", edges)) == 1
    assert "Join" not in edges


def test_pragma_masks_once(spark, many):
    assert plan(views.contracts(spark, many).select(code.pragma(F.col("text")).alias("version"))).count("zip_with") == 1


def test_verdicts_join_flags_and_broadcast_nothing(spark, many):
    findings = spark.range(100).select(F.col("id").alias("ord"), F.lit(8).alias("line"), F.lit("tx-origin").alias("type"), F.col("id").alias("doc_id"))
    found = plan(code.context_verdicts(findings, lexer.functions(views.contracts(spark, many)), {"tx-origin": "nonReentrant"}, "onlyOwner"))
    assert "Broadcast" not in found


def test_calls_of_a_repository_leave_the_join_once(spark, many):
    docs = views.contracts(spark, many)
    edges = code.repo_calls(lexer.functions(docs).join(session.shuffled(docs.select("doc_id", "repo")), "doc_id"), "repo")
    text = plan(edges)
    assert "Broadcast" not in text
    assert text.index("SortMergeJoin") > text.index("Union")  # nothing above the union but columns
    assert "HashAggregate" not in text[: text.index("Union")]


def test_calls_of_a_repository_are_dealt_to_tasks_by_their_edges(spark):
    """300 calls to 300 functions of a name are 90,000 edges although both sides are small; a name that nobody calls is sent nowhere."""
    body = "CASE WHEN id < 300 THEN 'far(1); near(2);' ELSE '' END"
    rows = spark.range(600).select(F.col("id").alias("doc_id"), (F.col("id") * 0).alias("repo"), F.when(F.col("id") < 300, "near").otherwise("far").alias("name"), F.expr(body).alias("body"))
    edges = code.repo_calls(rows, "repo", most=10_000)
    per_task = [r[1] for r in edges.where("dst = 'far'").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 90_000 and max(per_task) <= 45_000
    assert sorted(map(tuple, edges.where("dst = 'near'").collect())) == [(0, i, "near", i, "near") for i in range(300)]
    assert edges.distinct().count() == 90_300


def test_joins_of_paths_broadcast_nothing(spark, monkeypatch):
    """Every round's join, as the checkpoints leave it."""
    edges = spark.range(1, 400).select(F.col("id").alias("src"), F.floor(F.col("id") / 2).cast("long").alias("dst"))
    starts = edges.where("src > 390").select(F.col("src").alias("start"))
    frame, plans = type(edges), []
    keep = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda df, *a, **k: (plans.append(plan(df)), keep(df, *a, **k))[1])
    graph.reachable(edges, starts)
    graph.taint(edges, starts.select(F.col("start").alias("node"), F.lit("s").alias("label")), edges.select(F.col("dst").alias("node")).where("node = 7"))
    keyed = edges.select(F.lit(1).cast("long").alias("doc_id"), F.col("src").cast("string"), F.col("dst").cast("string"))
    crossing.components(keyed.where("src < 20"))
    docs = spark.createDataFrame([(1, "contract A { function f(address to) public { address b = to; address c = b; c.call(1); } }")], "doc_id long, text string")
    found = flows.tainted(lexer.functions(docs)).where("variable = 'c'").collect()
    crossing.findings(docs)
    assert [(r.sink, r.source) for r in found] == [("call", "function_parameter")]
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p]


def test_best_per_key_weighs_confidence_as_its_sql_does(spark, tmp_path):
    """At 1e9 a step of confidence, ids a thousand million apart outweigh one of less."""
    rows = [(5, 7, "click", 50.0, '{"k": 1}'), (4_000_000_005, 7, "click", 50.1, '{"k": 1}')]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").withColumn("ts", F.current_timestamp()).write.parquet(f"{tmp_path}/events.parquet")
    assert [r.ord for r in catalog.queries()["d9_best_per_key"](spark, str(tmp_path)).collect()] == [5]


def test_nearest_of_blocks_with_ties(spark, tmp_path):
    """Ties by id, also where scores differ by less than what is rounded; more queries than one slice has."""
    x = np.random.default_rng(3).normal(size=(600, 4))
    x[300:] = x[:300] * (1 + 1e-13)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    path = str(tmp_path / "index")
    vindex.build(rows, path, lists=3, chunk=100)
    for k in (1, 3):
        found = {(r["query"], r["rank"]): r["vec_id"] for r in vindex.search(spark, path, rows, k, None).collect()}
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = np.round(u @ u.T, 9)
        np.fill_diagonal(s, -np.inf)
        want = {(q, r + 1): j for q in range(600) for r, j in enumerate(np.lexsort((np.arange(600), -s[q]))[:k])}
        assert found == want


def test_lookup_shuffles_no_pairs_and_sums_as_a_loop_does(spark):
    tags = [[("b", n % 3)] * (n % 5 > 0) + [("w", (n * n) % 7), ("w", n % 4), ("w", n % 2)] for n in range(60)]
    index = spark.createDataFrame([(n, k, f"t{t}") for n, own in enumerate(tags) for k, t in own] + [(99, "w", None)], "doc long, kind string, tag string")
    got = joins.weighted_lookup(index.where("doc % 5 = 0").withColumnRenamed("doc", "query"), index, "tag", {"b": 0.8, "w": 0.3}, "query", "doc", 0.6, most=3)
    weight = lambda a, b: sum({"b": 0.8, "w": 0.3}[k] for k, _ in set(tags[a]) & set(tags[b]))
    want = {(a, b): round(weight(a, b), 6) for a in range(0, 60, 5) for b in range(60) if weight(a, b) >= 0.6 - 1e-12}
    rows = got.collect()
    assert len(rows) == len(want) and {(r.query, r.doc): round(r.score, 6) for r in rows} == want
    above, _, _ = plan(got).partition("SortMergeJoin")
    assert "Exchange" not in above and "Aggregate" not in above


def test_similar_sets_of_copies_meet_once_and_far_ones_stop_at_their_marks(spark):
    import random

    random.seed(5)
    common = [f"w{i}" for i in range(60)]
    sets = [random.sample(common, 25) for _ in range(25)]
    sets += [s + [f"x{i}"] for i, s in enumerate(sets[:8])] + [list(reversed(s)) for s in sets[:5]] + [sets[0]] * 6 + [[]]
    docs = spark.createDataFrame(list(enumerate(sets)), "doc_id long, s array<string>")
    got = {(r.a, r.b): round(r.similarity, 6) for r in joins.similar_sets(docs, "doc_id", "s", 0.9).collect()}
    alike = lambda x, y: len(set(x) & set(y)) / max(1, len(set(x) | set(y)))
    assert got == {(a, b): round(alike(x, y), 6) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and alike(x, y) >= 0.9}
    assert "bit_count" in plan(joins.similar_sets(docs, "doc_id", "s", 0.9))


def test_similar_sets_at_the_bound_meet_in_a_part_and_no_item_is_shuffled(spark, monkeypatch):
    """Sets of all sizes and others that differ from them in just as many items as they may, or in one more."""
    import random

    random.seed(8)
    least, sets = 0.8, []
    for n in [*range(1, 40), 77, 150, 151]:
        one = [f"w{i}" for i in random.sample(range(2_000), n)]
        for k in {0, n // 9, n // 9 + 1, n // 5, n // 5 + 1}:
            sets += [one[k:], one[k:] + [f"n{n}x{i}" for i in range(k)], [f"o{n}x{i}" for i in range(k // 2)] + one[: n - k // 2]]
    alike = lambda x, y: len(set(x) & set(y)) / max(1, len(set(x) | set(y)))
    want = {(a, b): round(alike(x, y), 6) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and alike(x, y) >= least}
    docs = spark.createDataFrame(list(enumerate(sets)), "doc_id long, s array<string>")
    frame, plans = type(docs), []
    keep = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda df, *a, **k: (plans.append(plan(df)), keep(df, *a, **k))[1])
    for most in (0, 1_000):
        found = joins.similar_sets(docs, "doc_id", "s", least, most=most)
        assert {(r.a, r.b): round(r.similarity, 6) for r in found.collect()} == want
    assert len(want) > 500 and not [p for p in plans if "Generate explode(items" in p]


def test_many_near_copies_are_scored_by_blocks(spark, monkeypatch):
    """60 near copies are 1,770 pairs; a set goes to a place per two blocks, not per pair."""
    monkeypatch.setattr(joins, "_BLOCK", 16)
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda x: F.concat(F.lit("w"), x)), F.array(F.concat(F.lit("own"), "id"))).alias("s"))
    found = joins.similar_sets(docs, "doc_id", "s", 0.9)
    assert found.count() == found.distinct().count() == 1_770
    assert [round(r.similarity, 6) for r in found.select("similarity").distinct().collect()] == [round(100 / 102, 6)]
    assert "place" in plan(found) and "items_a" not in plan(found)


def test_similar_documents_may_be_short(spark, tmp_path):
    texts = ["alpha beta", "Beta, alpha: alpha.", "alpha", "gamma", "alpha", "", None, "", "1 2", " ".join(chr(97 + i) for i in range(10)), " ".join(chr(97 + i) for i in range(9))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(0, 1, 1.0), (2, 4, 1.0), (9, 10, 0.9)]
    assert sorted(map(tuple, catalog.queries()["j9_similar_sets"](spark, str(tmp_path)).collect())) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = catalog.oracle_sql()["j9_similar_sets"]
    assert sorted(con.execute(f"WITH {sql[sql.index('t AS (SELECT doc_id, list_distinct') :]}").fetchall()) == want


def test_contracts_that_no_finding_names_are_not_searched(spark):
    contracts = spark.createDataFrame([(1, "contract A { using SafeMath for uint; }"), (2, None), (3, "function f() onlyOwner {}")], "doc_id long, text string")
    findings = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 9), (4, None)], "ord long, doc_id long")
    for most in (0, 100):
        found = verify.signs_at(findings, contracts, most=most)
        assert sorted((r.ord, r.uses_safemath) for r in found.collect()) == [(0, True), (1, True), (2, False)]
    many = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assert "semi" in verify.signed(findings, many)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_letters_are_not_counted_for_every_finding(spark):
    f = spark.createDataFrame([(i, "f", "g", 1, f"said {i % 3}", "x") for i in range(9)], "ord long, file string, function string, line int, message string, type string")
    assert "zip_with" not in plan(dedup.near_pairs(f))


def test_verdicts_of_clusters_are_remembered_over_files():
    a, b = ("reentrancy", "call in loop"), ("reentrancy", "call in a loop")
    before = clusters._comes_to.cache_info().hits
    assert clusters._reaches((*a, "x"), (*b, "x"), 0.7) and clusters._reaches((*a, "y"), (*b, "y"), 0.7)
    assert clusters._comes_to.cache_info().hits > before


def test_groups_are_the_components_of_the_pairs_and_list_none(spark):
    import random

    random.seed(2)
    for tolerance in (0, 1, 4):
        rows = [(i, random.choice(["f", "h", None]), random.choice(["a", "b", "", None]), random.choice([None, *range(30)]), random.choice(["reentrancy", "timestamp", "odd"])) for i in range(60)]
        f = spark.createDataFrame(rows, "ord long, file string, function string, line int, type string")
        want = dedup.components(correlate.methods(f, tolerance).select("a", "b"), f)
        assert sorted(map(tuple, correlate.groups(f, tolerance).collect())) == sorted(map(tuple, want.collect()))
    one_line = spark.range(300).select(F.col("id").alias("ord"), F.lit("f").alias("file"), F.lit("").alias("function"), F.lit(1).alias("line"), F.lit("odd").alias("type"))
    assert correlate.groups(one_line, 1).where(F.col("group") == 0).count() == 300


def test_transitions_do_not_read_lines_again_for_their_result(spark):
    lines = spark.range(3).select(F.lit("f").alias("fn"), F.col("id").cast("int").alias("n"), F.lit("s(x) := a(x)").alias("line"))
    found = flows.transitions(lines, spark.createDataFrame([("s",)], "variable string"), "fn")
    assert "Range (" not in plan(found)
    assert [(r.variable, r.depends_on, r.after_call) for r in found.collect()] == [("s", ["a"], False)]
