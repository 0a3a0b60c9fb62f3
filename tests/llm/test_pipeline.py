"""The pipeline, stage by stage, against brute force on the smallest documents."""

from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from pelagos.llm import common, mixing, queries, simhash

from .test_mixing import filled
from .test_packing import check

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.materialize(stage(spark, out[-1], SF), name))
    return out


def test_all_but_the_last_keep_the_columns(stages):
    assert [s.columns for s in stages[:-1]] == [COLUMNS] * 5


def test_clean_documents_stay_in_their_language(stages):
    before, after = stages[0], stages[1]
    assert after.count() == before.count()
    same = after.select("doc_id", F.col("lang").alias("found")).join(before, "doc_id").where("found = lang").count()
    assert same >= 0.95 * before.count()


def test_lines_match_sql(stages):
    con = duckdb.connect()
    con.register("documents", stages[1].toPandas())
    want = {r[0]: r for r in con.execute(f"SELECT doc_id, n_dropped, text FROM ({queries.ORACLES['op1_line_dedup']})").fetchall()}
    got = {r.doc_id: r for r in stages[2].collect()}
    assert {d: r.text for d, r in got.items()} == {d: r[2] for d, r in want.items()}
    assert all(r.n_chars == len(r.text) for d, r in got.items() if want[d][1])


def test_one_of_each_near_group_stays(stages):
    rows = stages[2].collect()
    sets = {r.doc_id: frozenset(simhash.shingles(r.text, 5)) for r in rows}
    group = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                lo, hi = sorted((group[a], group[b]))
                group = {d: lo if g == hi else g for d, g in group.items()}
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(set(group.values()))


def test_mix_repeats_documents(stages):
    rows = stages[3].collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(r.text.encode().split())
    want = filled(sizes, 1.5, 2.0)
    copies = {r.doc_id: r.copies for r in mixing.mix(stages[3], **queries.MIX).collect()}
    taken = Counter(r.doc_id for r in stages[4].collect())
    assert taken == Counter({d: n for d, n in copies.items() if n})
    for r in rows:
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert copies[r.doc_id] in (int(rate), int(rate) + 1)


def test_everything_that_is_left_is_packed(stages):
    check(stages[4], stages[5].collect(), queries.CAPACITY)


def test_run_gives_the_last_stage(spark, stages):
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(*key).collect())) == sorted(map(tuple, stages[5].select(*key).collect()))


def test_awkward_documents_go_through(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = common.materialize(stage(spark, docs, SF), name)
            if name != "pack":
                # Columns whose names the operators use themselves keep their order and values.
                assert docs.columns == before.columns
                for r in docs.collect():
                    assert all(r[c] == f"{c}:{'null' if r.doc_id is None else r.doc_id}" for c in docs.columns if c not in COLUMNS)
        assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert docs.count() == 0


def test_very_long_texts_go_through(spark):
    """A text of ten megabytes beside short ones, in every stage."""
    text = " ".join(f"word{i % 9973} number{i % 7919}" for i in range(520_000))
    rows = [(1, text, "en", "a", len(text)), (2, "a short text of some words in plain English", "en", "a", 43), (3, text + " end", "en", "b", len(text) + 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, SF), name)
    assert len(text) > 10_000_000 and {r.doc_id for r in docs.collect()} <= {1, 2}
