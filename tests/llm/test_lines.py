from pelagos.llm import lines


def kept(df, **options):
    return {r.doc_id: r.text for r in lines.dedup_lines(df, **options).collect()}


def test_templates_with_fields_are_dropped_but_for_the_first(spark):
    rows = [(i, f"{chr(97 + i)} own words\nvisited page {i} of 30 today\nShared footer line\n\n{'x' * i}") for i in range(8)]
    got = kept(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=5)
    assert got[0] == rows[0][1]
    assert got[3] == f"d own words\n\n{'x' * 3}"


def test_a_rare_token_at_a_place_is_a_field(spark):
    names = ["ada", "bob", "cyd", "dan", "eve", "flo"]
    rows = [(i, f"posted by user named {n} in the forum\nrest {n}") for i, n in enumerate(names)]
    got = kept(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=5)
    assert got[4] == "rest eve" and got[0] == rows[0][1]
    assert kept(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=7)[4] == rows[4][1]


def test_awkward_rows(awkward, nothing):
    rows = lines.dedup_lines(awkward).collect()
    assert len(rows) == awkward.count() and all(r.n_dropped == 0 for r in rows)
    assert {r.text for r in rows if r.doc_id in (2, 3)} == {""}
    assert lines.dedup_lines(nothing).count() == 0
    out = lines.without_recurring_lines(awkward, min_docs=1)
    assert out.columns == awkward.columns and out.count() == awkward.count()


def test_equal_rows_are_one_document(spark):
    rows = [(1, "same line here")] * 6 + [(2, "same line here")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=3).collect()
    assert all(r.n_dropped == 0 for r in got)
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=2).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(1, 0)] * 6 + [(2, 1)]
