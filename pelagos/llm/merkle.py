"""Merkle manifest of a dataset: a hash tree per source, one over the sources, and every row's proof.

The tree is built by superblocks: nodes are bucketed by their index divided by fanout^k, one task call collapses
k levels of a bucket, and the bucket roots are reduced in the same way until one node of each group is left.
Proofs come down the same tables: the proof of a bucket's root, found first, is appended to what a node needs
inside its bucket. No bucket has more than fanout^k nodes, whatever source they are of, so a source with a third
of all rows is only more buckets. Texts are hashed where they are read; digests alone are shuffled.

Nulls in any column have a mark of their own; a null source is a source, ordered first, and a null doc_id is an
id, ordered first. Rows with one doc_id follow each other by leaf, so reruns agree; equal rows have equal leaves at
different places. An empty table has no root and gives no rows. Columns of other names are not read.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.llm import common

#: What a document's leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "grp long, n long, idx long, h string"
#: A proof from a node upwards: for every level, the digests left and right of it in its run, as text.
PROOF = "array<struct<before: string, after: string>>"


def digest(*parts: str) -> str:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values: list[Column]) -> Column:
    """Digest of a row's values: ``-`` for null, else UTF-8 length, colon and value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def lowered(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


# ---- inside a bucket ------------------------------------------------------------------------------


def run_of(level: list[str], at: int, fanout: int) -> tuple[int, list[str]]:
    """Where the run that holds node ``at`` begins, and its nodes."""
    first = at - at % fanout
    return first, level[first : first + fanout]


def collapse(nodes: list[str], depth: int, fanout: int) -> list[list[str]]:
    """The levels over ``nodes``, ``depth`` of them; the last is the bucket's root if depth is enough."""
    levels = [nodes]
    for _ in range(depth):
        below = levels[-1]
        levels.append([digest(*below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return levels


def depth_of(nodes: int, in_group: int, k: int, fanout: int) -> int:
    """Levels that a bucket is to collapse: all k while the group has further buckets, else until one node is left."""
    if in_group > fanout**k:
        return k
    depth = 0
    while nodes > 1:
        nodes, depth = -(-nodes // fanout), depth + 1
    return depth


def inner_proof(levels: list[list[str]], at: int, fanout: int) -> list[dict]:
    """What node ``at`` of the lowest level needs to give the root of its bucket."""
    out = []
    for level in levels[:-1]:
        first, run = run_of(level, at, fanout)
        out.append({"before": "".join(run[: at - first]), "after": "".join(run[at - first + 1 :])})
        at //= fanout
    return out


def fold(h: str, proof: list) -> str:
    """The root that a node's digest and its proof give."""
    for step in proof:
        h = digest(step["before"], h, step["after"])
    return h


# ---- over tables ----------------------------------------------------------------------------------


def tree(nodes: DataFrame, fanout: int, k: int) -> list[DataFrame]:
    """``nodes(grp, n, idx, h)`` and every k-th level above them, up to the one node of each group. ``n`` is the
    number of the group's nodes on the level, ``idx`` counts from 0. Every level is a table in the shared folder."""
    span = fanout**k

    def root(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        n = int(rows["n"].iloc[0])
        top = collapse(rows["h"].tolist(), depth_of(len(rows), n, k, fanout), fanout)[-1][0]
        return pd.DataFrame({"grp": rows["grp"].iloc[:1], "n": [-(-n // span)], "idx": [int(rows["idx"].iloc[0]) // span], "h": [top]})

    levels = [nodes]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        dealt = levels[-1].groupBy("grp", F.floor(F.col("idx") / span).alias("bucket"))
        levels.append(common.materialize(dealt.applyInPandas(root, NODE), "level"))
    return levels


def descend(level: DataFrame, above: DataFrame, fanout: int, k: int, finish: Callable, schema: str) -> DataFrame:
    """What ``finish(rows, proofs, upper)`` gives for the nodes of each bucket: ``above(grp, idx, proof, ...)`` holds
    the bucket's root's proof and whatever else is to come down; ``proofs`` gives a node's whole proof by its place."""
    span = fanout**k

    def of_bucket(rows: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx").reset_index(drop=True)
        levels = collapse(rows["h"].tolist(), depth_of(len(rows), int(rows["n"].iloc[0]), k, fanout), fanout)
        rest = list(upper["proof"].iloc[0])
        return finish(rows, lambda at: inner_proof(levels, at, fanout) + rest, upper.iloc[0])

    own = level.groupBy("grp", F.floor(F.col("idx") / span).alias("bucket"))
    theirs = above.groupBy("grp", F.col("idx").cast("long").alias("bucket"))
    return own.cogroup(theirs).applyInPandas(of_bucket, schema)


def inner_proofs(levels: list[DataFrame], above: DataFrame, carried: list[str], fanout: int, k: int) -> DataFrame:
    """From ``above``, the proofs of the topmost level's nodes with ``carried`` columns, those of level 1."""
    schema = f"grp long, idx long, proof {PROOF}, " + ", ".join(f"{c} string" for c in carried)

    def finish(rows: pd.DataFrame, proofs: Callable, upper: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"grp": rows["grp"], "idx": rows["idx"], "proof": [proofs(i) for i in range(len(rows))]})
        return out.assign(**{c: upper[c] for c in carried})

    for level in levels[-2:0:-1]:
        above = common.materialize(descend(level, above, fanout, k, finish, schema), "proofs")
    return above


def placed(docs: DataFrame, claimed: Column) -> tuple[DataFrame, DataFrame]:
    """Leaves ``(doc_id, claimed, grp, n, idx, h)`` in their places, and sources ``(source, grp, n)``. ``claimed`` is
    the leaf that is to be verified, null if it is the row's own. A group is named by where its first leaf stands
    among all; ids travel as text, so that a null among them changes no other."""
    own = docs.select(F.col("doc_id").cast("string").alias("id"), "doc_id", "source", leaf([F.col(c) for c in FIELDS]).alias("h"), claimed.alias("claimed"))
    order = [F.col(c).asc_nulls_first() for c in ("source", "doc_id", "h", "claimed")]
    ordered = common.ordered_index(common.materialize(own, "hashed"), order, "place")
    sources = common.materialize(ordered.groupBy("source").agg(F.min("place").alias("grp"), F.count("*").alias("n")), "sources")
    few = common.small_or_shuffled(sources.withColumnRenamed("source", "of"))
    rows = ordered.join(few, F.col("source").eqNullSafe(F.col("of")))
    return rows.select(F.col("id").alias("doc_id"), F.coalesce("claimed", "h").alias("claimed"), "grp", "n", (F.col("place") - F.col("grp")).alias("idx"), "h"), sources


def verified(docs: DataFrame, claimed: Column, finish: Callable, schema: str, fanout: int = 16, k: int = 2) -> DataFrame:
    """``finish(rows, proofs, upper)`` for every bucket of leaves of ``docs``, ``upper`` with ``subroot`` and ``root``."""
    leaves, sources = placed(docs, claimed)
    leaves = common.materialize(leaves, "leaves")
    own = tree(leaves.select("grp", "n", "idx", "h"), fanout, k)
    subroots = own[-1].where("n = 1").join(sources.select("grp", "source"), "grp").select("grp", "source", "h")
    ordered = common.ordered_index(subroots, [F.col("source").asc_nulls_first()])
    total = F.lit(sources.count())
    ordered = common.materialize(ordered.select(F.lit(0).cast("long").alias("grp"), total.cast("long").alias("n"), "idx", "h", F.col("grp").alias("of")), "subroots")
    over = tree(ordered.select("grp", "n", "idx", "h"), fanout, k)
    none = F.array().cast(PROOF).alias("proof")
    above = inner_proofs(over, over[-1].select("grp", "idx", none, F.col("h").alias("root")), ["root"], fanout, k)
    if len(over) > 1:

        def of_subroot(rows: pd.DataFrame, proofs: Callable, upper: pd.Series) -> pd.DataFrame:
            made = [proofs(i) for i in range(len(rows))]
            return pd.DataFrame({"grp": rows["of"], "idx": 0, "proof": made, "subroot": rows["h"], "root": upper["root"]})

        tops = descend(ordered, above, fanout, k, of_subroot, f"grp long, idx long, proof {PROOF}, subroot string, root string")
    else:
        tops = ordered.select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("idx"), none, F.col("h").alias("subroot"), F.col("h").alias("root"))
    tops = common.materialize(tops, "tops")
    if len(own) == 1:  # every source has one leaf: the leaves are the top themselves
        own = [own[0], own[0]]
    above = inner_proofs(own, tops, ["subroot", "root"], fanout, k)
    return descend(leaves, above, fanout, k, finish, schema).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def proofs(docs: DataFrame, fanout: int = 16, k: int = 2) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof)`` for every row: the manifest with whole proofs, about a kilobyte a level."""

    def finish(rows: pd.DataFrame, of: Callable, upper: pd.Series) -> pd.DataFrame:
        made = [of(i) for i in range(len(rows))]
        return pd.DataFrame({"doc_id": rows["doc_id"], "leaf": rows["h"], "subroot": upper["subroot"], "root": upper["root"], "proof": made})

    return verified(docs, F.lit(None).cast("string"), finish, f"doc_id string, leaf string, subroot string, root string, proof {PROOF}", fanout, k)


def audit(docs: DataFrame, where: Column, text: Column, fanout: int = 16, k: int = 2) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` for every row: the root that the row gives
    with its own proof, with ``text`` for its text if ``where`` holds, and whether it is the root."""
    claimed = F.when(where, leaf([text if c == "text" else F.col(c) for c in FIELDS]))

    def finish(rows: pd.DataFrame, of: Callable, upper: pd.Series) -> pd.DataFrame:
        hashed, folded = [], []
        for i, h in enumerate(rows["claimed"]):
            proof = of(i)
            hashed.append(digest(*[x for step in proof for x in (step["before"], step["after"])]))
            folded.append(fold(h, proof))
        out = pd.DataFrame({"doc_id": rows["doc_id"], "leaf": rows["h"], "subroot": upper["subroot"], "root": upper["root"], "proof_sha256": hashed, "folded_root": folded})
        return out.assign(verified=out["folded_root"] == out["root"])

    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return verified(docs, claimed, finish, schema, fanout, k)
