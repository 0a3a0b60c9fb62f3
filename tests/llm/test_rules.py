import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pelagos.llm import rules


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def test_statistics_match_brute_force(documents, awkward):
    for df in (documents, awkward):
        got = sorted(tuple(r)[:7] for r in rules.judge(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").na.fill(-1, ["doc_id"]).collect())
        assert got == sorted(((-1 if r.doc_id is None else r.doc_id), *base(r.text)) for r in df.collect())


def fast_mcd(x, share=0.75, starts=200):
    """Least determinant over many random starts in numpy, each run until its rows stay the same."""
    floor = np.diag([s**2 for _, s in rules.STATS])
    rng = np.random.default_rng(0)
    h = int(np.ceil(share * len(x)))
    best = None
    for _ in range(starts):
        near = x[rng.choice(len(x), min(len(x), 12), replace=False)]
        before = None
        while True:
            centre, cov = near.mean(axis=0), rules.CONSISTENCY * np.cov(near.T, bias=True).reshape(5, 5) + floor
            det = np.linalg.slogdet(cov)[1] / 2
            if before is not None and det >= before - 1e-9:
                break
            before = det if len(near) == h else None
            d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            near = x[np.argsort(d2, kind="stable")[:h]]
        if best is None or det < best[0]:
            best = det, centre, cov
    return best


def test_least_determinant_of_each_group_matches_numpy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stats = rules.statistics(docs).where("not base_failed")
    names = [n for n, _ in rules.STATS]
    found = rules.estimate(stats.selectExpr("concat_ws('/', lang, source) g", "xxhash64(doc_id) draw", *names)).toPandas().set_index("g")
    groups = stats.toPandas().groupby(["lang", "source"])
    assert len(found) == len(groups) > 4
    for (lang, source), rows in groups:
        x = rows[names].to_numpy().round(3)
        det, centre, _ = fast_mcd(x)
        got = found.loc[f"{lang}/{source}"]
        # Distances fall into classes 0.8 % wide, so that a row or two more may be among the nearest.
        assert got.det <= det + 0.05
        if len(x) > 50:
            assert np.abs(got[[f"m_{i}" for i in range(5)]].to_numpy(float) - centre).max() < 0.1


def test_starts_escape_a_cluster_of_outliers(spark):
    """A fifth of the rows far away in one place do not move the centre."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (800, 5)), rng.normal(0, 0.1, (200, 5)) + 6])
    names = [n for n, _ in rules.STATS]
    rows = spark.createDataFrame([("a", i, *map(float, r)) for i, r in enumerate(x)], "g string, draw long, " + ", ".join(f"{n} double" for n in names))
    got = rules.estimate(rows).first()
    assert max(abs(got[f"m_{i}"]) for i in range(5)) < 0.3


def test_reruns_and_layouts_agree(documents):
    key = lambda df: sorted(map(tuple, df.select("doc_id", "distance", "kept").collect()), key=repr)
    assert key(rules.judge(documents)) == key(rules.judge(documents.repartition(7)))


def test_small_groups_are_judged_by_their_language(spark, documents):
    rows = documents.withColumn("source", F.when(F.col("doc_id") == 7, "alone").otherwise(F.lit("most")))
    long_words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: F.concat(F.lit("#$%&*|<>"), i.cast("string"), F.lit("QXZ" * 9))), " ")
    far = rows.withColumn("text", F.when(F.col("doc_id") == 7, long_words).otherwise(F.col("text")))
    got = {r.doc_id: r for r in rules.judge(far).collect()}
    assert not got[7].base_failed and not got[7].kept


def test_junk_goes_and_clean_text_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = rules.judge(docs).where("not base_failed").join(labels, "doc_id").select("kept", "quality").collect()
    clean, junk = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.98 * len(clean) and sum(junk) <= 0.1 * len(junk)


def test_awkward_rows(awkward, nothing):
    rows = {r.doc_id: r for r in rules.judge(awkward).collect()}
    assert not rows[2].kept and rows[2].n_words == 0 and rows[5].n_repeat_words == 3000
    assert rules.judge(nothing).count() == 0


def test_verdicts_against_plain_shrinking_and_distances(documents):
    """``kept`` from the estimates: groups mixed with their language's, those with all rows', factor, distance, cutoff."""
    names, floors = [n for n, _ in rules.STATS], [f for _, f in rules.STATS]
    k = range(len(names))
    stats = rules.statistics(documents).where("not base_failed")
    levelled = rules._levels(stats)
    draw = F.xxhash64("doc_id", "n_words", "word_chars", *names).alias("draw")
    found = {r.g: r for r in rules.estimate(levelled.select(F.explode(F.array("g0", "g1", "g2")).alias("g"), draw, *names)).collect()}
    parts = lambda r: (r.n, np.array([r[f"m_{i}"] for i in k]), np.array([[r[f"c_{min(i, j)}_{max(i, j)}"] for j in k] for i in k]))

    def mixed(narrow, wide, prior=50):
        n, m, c = narrow
        return n, (n * m + prior * wide[0]) / (n + prior), (n * c + prior * wide[1]) / (n + prior)

    want = {}
    for r in levelled.collect():
        _, m0, c0 = parts(found["0"])
        _, m1, c1 = mixed(parts(found[r.g1]), (m0, c0))
        _, m, c = mixed(parts(found[r.g2]), (m1, c1))
        c = c * rules.CONSISTENCY + np.diag([f**2 for f in floors])
        x = np.array([r[n] for n in names]) - m
        want[r.doc_id] = float(x @ np.linalg.solve(c, x))
    got = {r.doc_id: r for r in rules.judge(documents).collect()}
    for doc_id, d2 in want.items():
        assert abs(got[doc_id].distance ** 2 - d2) < 1e-6 * max(1, d2)
        assert got[doc_id].kept == (d2 <= rules.CUTOFF)
    assert all(not r.kept and r.distance is None for i, r in got.items() if i not in want)
