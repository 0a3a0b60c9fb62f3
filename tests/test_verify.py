"""Findings that hold or not, titles that match, exports, against plain loops."""

import random

from pyspark.sql import functions as F

from pelagos.operators import joins, verify
from pelagos.sinks import writers

SIDE = "file string, ord long, swc_id string, title string"


def says_the_same(p, t):
    if p[2] and p[2] == t[2]:
        return True
    a, b = p[3].lower(), t[3].lower()
    return bool(a and b) and (a in b or b in a or any(w in a and w in b for w in verify.TITLE_WORDS))


def test_titles_match_as_in_a_loop(spark):
    rng = random.Random(2)
    words = ["Reentrancy", "price", "Oracle", "gas", "Storage", "x", "flash loan", ""]
    make = lambda n: [(f"f{rng.randrange(6)}", i, rng.choice(["", "SWC-107", "SWC-101"]), f"{rng.choice(words)} {rng.choice(words)}".strip()) for i in range(n)]
    predicted, truth = make(60), make(50)
    p, t = spark.createDataFrame(predicted, SIDE), spark.createDataFrame(truth, SIDE)
    pairs = verify.title_pairs(p, t, ["file"])
    assert {(r.p, r.t) for r in pairs.collect()} == {(a[1], b[1]) for a in predicted for b in truth if a[0] == b[0] and says_the_same(a, b)}
    want = {}
    for file in {a[0] for a in predicted + truth}:
        used, tp = set(), 0
        for a in sorted(x for x in predicted if x[0] == file):
            hit = next((b for b in sorted(x for x in truth if x[0] == file) if b[1] not in used and says_the_same(a, b)), None)
            if hit:
                used.add(hit[1])
                tp += 1
        want[file] = (tp, sum(a[0] == file for a in predicted) - tp, sum(b[0] == file for b in truth) - tp)
    got = verify.matched_counts(p, t, joins.one_to_one(pairs, ["file"], "p", "t"), ["file"])
    assert {r.file: (r.tp, r.fp, r.fn) for r in got.collect()} == want


def test_false_positive_scores(spark):
    rows = [("reentrancy", 0.9, 2, "SWC-107", True, False), ("timestamp", None, 1, None, False, False), ("arithmetic", 0.1, 1, "", False, True), (None, 0.5, 1, "", True, True)]
    f = spark.createDataFrame(rows, "type string, confidence double, tools int, swc_id string, has_reentrancy_guard boolean, is_solidity_08_plus boolean")
    got = {r.type: (r.fp_score, r.likely_fp) for r in verify.false_positive_score(f).collect()}
    assert got == {"reentrancy": (0.45, False), "timestamp": (0.42, False), "arithmetic": (0.77, True), None: (0.77, True)}


def test_experiment_record_does_not_depend_on_order(spark):
    f = spark.createDataFrame([(i, "t", "x", "low") for i in range(50)], "ord long, tool string, type string, severity string")
    one, two = (writers.experiment(x, "n", {"b": "2", "a": "1"}).first() for x in (f, f.orderBy(F.desc("ord")).repartition(3)))
    assert one == two and one.parameters == '{"a":"1","b":"2"}' and one.n == 50


def test_anchored_groups_match_a_loop(spark):
    from pelagos.operators import correlate

    rng = random.Random(6)
    rows = [(i, "t", "High", rng.choice(["timestamp", "arithmetic"]), rng.choice("ab"), "f", rng.randrange(60), "m", 0.5) for i in range(200)]
    f = spark.createDataFrame(rows, "ord long, tool string, severity string, type string, file string, function string, line int, message string, confidence double")
    anchors, want = {}, {}
    for r in rows:
        own = anchors.setdefault((r[3], r[4]), [])
        want[r[0]] = next((a for a, n in own if abs(n - r[6]) <= 5), r[0])
        if want[r[0]] == r[0]:
            own.append((r[0], r[6]))
    assert {r.ord: r.anchor for r in correlate.anchored(f).collect()} == want


def test_settings_merge(spark):
    from pelagos.operators import score

    rows = spark.createDataFrame([({"a": {"x": "1", "y": "2"}}, {"a": {"y": "3"}, "b": {"z": "4"}}), (None, {"a": {}})], "one map<string,map<string,string>>, two map<string,map<string,string>>")
    got = [r.m for r in rows.select(score.merged_maps(F.col("one"), F.col("two")).alias("m")).collect()]
    assert got == [{"a": {"x": "1", "y": "3"}, "b": {"z": "4"}}, {"a": {}}]
