"""The vector index against exact search, and vectors of code."""

import random

import pytest
from pyspark.sql import functions as F

from pelagos.operators import embed, vectors, vindex

SCHEMA = "vec_id long, embedding array<double>"


@pytest.fixture(scope="module")
def clustered(spark):
    random.seed(1)
    centres = [[random.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(i, [c + random.gauss(0, 0.3) for c in centres[i % 30]]) for i in range(3000)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_recall_of_probes_and_the_exact_way(spark, clustered, tmp_path):
    path = str(tmp_path / "index")
    vindex.build(clustered, path, lists=32, sample=1000, chunk=40)
    asked = clustered.where("vec_id % 100 = 0")
    exact = vectors.top_k(clustered, asked, 10).cache()
    everywhere = vindex.search(spark, path, asked, 10, None)
    key = lambda df: sorted((r.query, r.rank, r.vec_id) for r in df.collect())
    assert key(everywhere) == key(exact)
    probed = vindex.search(spark, path, asked, 10, 6)
    shares = [r.recall for r in vindex.recall(probed, exact).collect()]
    assert len(shares) == 30 and sum(shares) / 30 >= 0.9
    # only the lists that are probed are read
    one = clustered.where("vec_id = 0")
    plan = vindex.search(spark, path, one, 1, 1)
    assert plan.count() == 1
    assert key(vindex.search(spark, path, asked, 10, None, block=7)) == key(exact)


def test_blocks_of_queries_read_the_lists_and_shuffle_no_vector(spark, clustered, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    vindex.build(clustered, path, lists=8, chunk=100)
    asked = clustered.where("vec_id % 10 = 0")
    frame, plans = type(clustered), []
    keep = frame.checkpoint
    show = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(frame, "checkpoint", lambda df, *a, **k: (plans.append(show(df)), keep(df, *a, **k))[1])
    found = vindex.search(spark, path, asked, 4, None, block=64)
    plans.append(show(found))
    assert not [p for p in plans if "CoGroup" in p or "Join" in p] and sum("MapInArrow" in p for p in plans) == 5
    assert all("embedding" not in line for p in plans for line in p.splitlines() if "Exchange" in line)
    key = lambda df: sorted((r.query, r.rank, r.vec_id, r.similarity) for r in df.collect())
    assert key(found) == key(vectors.top_k(clustered, asked, 4))


def test_rows_added_later_are_found(spark, clustered, tmp_path):
    path = str(tmp_path / "index")
    vindex.build(clustered.where("vec_id < 1500"), path, lists=8)
    centres = vindex.centroids(spark, path)
    vindex.add(clustered.where("vec_id >= 1500"), path)
    assert (vindex.centroids(spark, path) == centres).all()
    assert spark.read.parquet(f"{path}/lists").count() == 3000
    asked = clustered.where("vec_id in (7, 2990)")
    key = lambda df: sorted((r.query, r.rank, r.vec_id) for r in df.collect())
    assert key(vindex.search(spark, path, asked, 5, None)) == key(vectors.top_k(clustered, asked, 5))


def test_one_vector_a_third_of_all_and_odd_rows(spark, tmp_path):
    """Copies are dealt to chunks; nulls, zero and non-finite vectors and those of other lengths do not break the index."""
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(300)] + [(1000 + i, [0.1 * i, 1.0, 0.5]) for i in range(300)]
    rows += [(2000, None), (None, [1.0, 0.0, 0.0]), (2001, [1.0]), (2002, [float("nan"), 0.0, 0.0]), (2003, [None, 1.0, 0.0]), (2004, [0.0, 0.0, 0.0])]
    df, path = spark.createDataFrame(rows, SCHEMA), str(tmp_path / "index")
    vindex.build(df, path, lists=4, chunk=32)
    sizes = [r["count"] for r in spark.read.parquet(f"{path}/lists").groupBy("list", "chunk").count().collect()]
    assert sum(sizes) == 601 and max(sizes) < 90
    got = vindex.search(spark, path, df.where("vec_id = 5"), 3, None).orderBy("rank").collect()
    assert [(r.vec_id, r.similarity) for r in got] == [(0, 1.0), (1, 1.0), (2, 1.0)]
    assert vindex.search(spark, path, df.limit(0), 3, None).count() == 0
    with pytest.raises(ValueError, match="no vector"):
        vindex.build(df.where("vec_id = 2000"), str(tmp_path / "none"))


CODE = "contract A { function f(uint x) public { require(x > 0); msg.sender.call{value: x}(''); } } // note"


def test_equal_code_has_equal_vectors(spark):
    """Comments, layout, other documents and the order of rows change nothing; other code has another vector."""
    other = "contract B { function g() external view returns (uint) { for (uint i; i < 9; i++) { total += i; } return total; } }"
    docs = spark.createDataFrame([(1, CODE), (2, CODE.replace(" // note", "\n/* selfdestruct(x) */").replace("  ", " ")), (3, other), (4, None), (5, ""), (6, "// only words")], "doc_id long, text string")
    got = {r.doc_id: r.vector for r in embed.code_vectors(docs).collect()}
    again = {r.doc_id: r.vector for r in embed.code_vectors(docs.where("doc_id <= 3").orderBy(F.desc("doc_id")).repartition(3)).collect()}
    assert got[1] == got[2] == again[1] and got[3] == again[3]
    assert all(len(v) == embed.DIMENSIONS for v in got.values())
    assert sum(x * x for x in got[1]) == pytest.approx(1) and not any(got[4]) and not any(got[5]) and not any(got[6])
    near = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    renamed = spark.createDataFrame([(7, CODE.replace("x", "y"))], "doc_id long, text string")
    (row,) = embed.code_vectors(renamed).collect()
    assert near(got[1], row.vector) > 0.5 > near(got[1], got[3])
