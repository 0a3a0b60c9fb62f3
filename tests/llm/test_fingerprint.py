import hashlib

from pelagos.llm import fingerprint, simhash


def order(row):
    return (row[0] is not None, row[0] or 0, row[1] or "")


def check(df, rows):
    rows = sorted(((r[0], r[1] or "") for r in rows), key=order)
    want = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        want.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprint.fingerprint(text) % 2**64))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fp % 2**64) for r in fingerprint.against_edits(df).collect()]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_matches_brute_force(documents):
    check(documents, [(r.doc_id, r.text) for r in documents.collect()])


def test_awkward_rows(awkward, nothing, spark):
    check(awkward, [(r.doc_id, r.text) for r in awkward.collect()])
    assert fingerprint.against_edits(nothing).count() == 0
    one = spark.createDataFrame([(7, "one row alone here")], "doc_id long, text string")
    check(one, [(7, "one row alone here")])


def test_edits_are_nearer_than_the_next(documents):
    rows = [r for r in fingerprint.against_edits(documents).collect() if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in rows) > 0.9 * len(rows)
    assert sum(r.near_edited for r in rows) / len(rows) > 0.5


def test_search_finds_all_within_the_radius(spark, documents):
    base = [r.fp for r in fingerprint.against_edits(documents).select("fp").distinct().collect()]
    unsigned = [b % 2**64 for b in base]
    unsigned = sorted({u ^ f for u in unsigned[:60] for f in (0, 1, 3 << 40, 1 << 63 | 5, 15)})
    points = spark.createDataFrame([(simhash._signed(u),) for u in unsigned], "fp long")
    for radius in (1, 3, 5):
        got = {(r.q % 2**64, r.fp % 2**64) for r in fingerprint.search(points.withColumnRenamed("fp", "q"), points, radius).collect()}
        assert got == {(a, b) for a in unsigned for b in unsigned if (a ^ b).bit_count() <= radius}
    assert simhash.blocks_for(10**6, 3) == 4 and simhash.blocks_for(10**10, 3) > 4
