"""Greedy matching in rounds against one pass, and the bound on the ratio of matching blocks."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from pelagos.operators import dedup, joins


def one_pass(pairs):
    used_l, used_r, out = set(), set(), set()
    for g, a, b in sorted(pairs):
        if (g, a) not in used_l and (g, b) not in used_r:
            used_l.add((g, a))
            used_r.add((g, b))
            out.add((g, a, b))
    return out


def test_rounds_give_what_one_pass_gives(spark):
    random.seed(4)
    pairs = {(g, random.randrange(40), random.randrange(40)) for g in range(6) for _ in range(120)}
    pairs |= {(10, i, i + d) for i in range(60) for d in (0, 1)} | {(11, i, j) for i in range(25) for j in range(25)} | {(12, i + 1, i) for i in range(40)} | {(12, i, i) for i in range(40)}
    df = spark.createDataFrame(sorted(pairs, key=hash), "g int, a int, b int")
    want = one_pass(pairs)
    for rounds in (0, 3):
        got = [tuple(r) for r in joins.one_to_one(df.unionByName(df.limit(50)), ["g"], "a", "b", rounds).collect()]
        assert len(got) == len(set(got)) and set(got) == want, rounds
    assert joins.one_to_one(df.limit(0), ["g"], "a", "b").collect() == []


def test_groups_may_be_null(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 1, 2), (None, 2, 1), ("x", 1, 1), ("x", None, 2)], "g string, a int, b int")
    assert {tuple(r) for r in joins.one_to_one(df, ["g"], "a", "b").collect()} == {(None, 1, 1), ("x", 1, 1)}


def test_bound_is_never_below_the_ratio(spark):
    random.seed(8)
    words = ["reentrancy", "in", "Withdraw", "(line 12)", "überlauf", "overflow", "of", "total", "\U0001f600", ""]
    texts = [" ".join(random.choice(words) for _ in range(random.randrange(6))) for _ in range(120)] + ["", None]
    df = spark.createDataFrame([(random.choice(texts), random.choice(texts)) for _ in range(1500)], "a string, b string")
    rows = df.select("a", "b", dedup.ratio_bound(dedup.letter_counts(F.col("a")), dedup.letter_counts(F.col("b"))).alias("bound")).collect()
    ratio = lambda x, y: SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio()
    assert all(r.bound >= ratio(r.a, r.b) - 1e-9 for r in rows)
    left = [r for r in rows if r.bound >= 0.85]
    assert {(r.a, r.b) for r in rows if ratio(r.a, r.b) >= 0.85} <= {(r.a, r.b) for r in left}
    assert len(left) < 0.4 * len(rows)  # the share of pairs that are compared block by block


def test_near_pairs_with_and_without_the_bound(spark):
    random.seed(3)
    said = ["sum may overflow", "sum may overflow!", "owner is not checked", "owner isn't checked", "call before write", None]
    rows = [(i, "f", "g", random.randrange(60), random.choice(said), random.choice(["arithmetic", "timestamp", "odd one", None])) for i in range(150)]
    df = spark.createDataFrame(rows, "ord long, file string, function string, line int, message string, type string")
    got = {tuple(r) for r in dedup.near_pairs(df).collect()}
    category = {r.ord: r.c for r in df.select("ord", dedup.S.category(F.col("type")).alias("c")).collect()}
    alike = lambda x, y: (category[x[0]] is not None and category[x[0]] == category[y[0]]) or SequenceMatcher(None, (x[4] or "").lower(), (y[4] or "").lower()).ratio() >= 0.85
    assert got == {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and abs(x[3] - y[3]) <= 5 and alike(x, y)}


def test_bounds_of_clusters_change_no_verdict():
    from pelagos.operators import clusters

    random.seed(1)
    words = ["reentrancy", "overflow", "sum may", "call in loop", "owner", "x", "Über", ""]
    near = lambda x, y: SequenceMatcher(None, x, y).ratio()
    said = lambda: " ".join(random.choice(words) for _ in range(random.randrange(5)))
    reached = 0
    for _ in range(5000):
        a, b = (clusters._parts((random.choice(words) + random.choice(words), said(), random.choice("ab"))) for _ in range(2))
        score = 0.3 * near(a[0], b[0]) + 0.3 * near(a[1], b[1]) + 0.2 * (a[2] == b[2]) + 0.2
        assert clusters._reaches(a, b, 0.7) == (score >= 0.7)
        reached += score >= 0.7
    assert 50 < reached < 4500
