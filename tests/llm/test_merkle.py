from hashlib import sha256
from zlib import crc32

from pyspark.sql import functions as F

from pelagos.llm import merkle

FANOUT = 16


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def reduced(nodes, fanout):
    """The levels of one tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def siblings(levels, at, fanout):
    for level in levels[:-1]:
        first = at - at % fanout
        yield level[first:at], level[at + 1 : first + fanout]
        at //= fanout


def plain(rows, fanout=FANOUT):
    """Every row's (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one document after the other."""
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees[s] = reduced([leaf(r, r.text) for r in by[s]], fanout)
    top = reduced([trees[s][-1][0] for s in names], fanout)
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            bad = r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if bad else r.text
            folded, proof = leaf(r, text), ""
            for left, right in [*siblings(trees[s], i, fanout), *siblings(top, k, fanout)]:
                folded, proof = h(*left, folded, *right), proof + "".join(left + right)
            out.append((r.doc_id, leaf(r, r.text), trees[s][-1][0], top[-1][0], h(proof), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def audited(docs, **sizes):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle.audit(docs, tampered, merkle.lowered(F.col("text")), **sizes)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    return sorted(map(tuple, got.collect()), key=repr)


def test_against_plain_trees(documents):
    want = plain(documents.collect())
    assert audited(documents, fanout=FANOUT, k=2) == want
    assert {r[-1] for r in want} == {True, False}


def test_deep_trees_and_many_sources(spark, documents):
    """Small fanouts make trees of many levels and more superblocks than one table; the layout of the rows changes nothing."""
    rows = spark.range(300).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") < 120, "hot").when(F.col("id") < 220, F.concat(F.lit("s"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("t"), (F.col("id") % 7).cast("string"))).alias("source"),
        F.col("id").alias("n_chars"),
    )
    plainly = plain(rows.collect(), 3)
    for k in (1, 2, 3):
        assert audited(rows, fanout=3, k=k) == plainly
    assert audited(rows.repartition(7), fanout=3, k=2) == plainly
    assert audited(documents, fanout=2, k=3) == plain(documents.collect(), 2)


def test_one_leaf_each_and_one_leaf_alone(spark):
    rows = spark.createDataFrame([(i, "T", "en", f"s{i}", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    assert audited(rows, fanout=FANOUT, k=2) == plain(rows.collect())
    alone = rows.limit(1)
    (row,) = audited(alone, fanout=FANOUT, k=2)
    assert row[1] == row[2] == row[3] and row[4] == h("")
    assert [row] == plain(alone.collect())


def test_proofs_fold_to_the_root(documents):
    rows = merkle.proofs(documents).collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert merkle.fold(r.leaf, r.proof) == r.root
        assert merkle.fold(h(r.leaf), r.proof) != r.root


def test_awkward_rows(spark, awkward, nothing):
    assert audited(awkward, fanout=FANOUT, k=2) == plain(awkward.collect())
    assert audited(awkward, fanout=2, k=1) == plain(awkward.collect(), 2)
    assert audited(nothing, fanout=FANOUT, k=2) == []
    big = 2**62 + 1
    long = spark.createDataFrame([(big, "Wort " * 2_000_000, "de", "a", None), (None, "x", None, "a", 1)], nothing.schema)
    got = audited(long, fanout=FANOUT, k=2)
    assert got == plain(long.collect()) and big in {r[0] for r in got}
