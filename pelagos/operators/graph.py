"""Reachability, paths and taint over edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos import session


def reachable(edges: DataFrame, starts: DataFrame, rounds: int = 50) -> DataFrame:
    """``(start, node)``: every node that can be reached from each start, itself included. Semi-naive: each round joins
    only the pairs that are new, and lineage is cut with a checkpoint."""
    session.ensure_checkpoint_dir(edges.sparkSession)
    flows = session.shuffled(edges.select("src", "dst").checkpoint())
    new = starts.select("start", F.col("start").alias("node")).distinct().checkpoint()
    known = [new]
    for _ in range(rounds):
        step = new.join(flows, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        # Each round writes its new pairs only.
        new = step.join(session.shuffled(reduce(DataFrame.unionByName, known)), ["start", "node"], "left_anti").checkpoint()
        if new.isEmpty():
            return reduce(DataFrame.unionByName, known)
        known.append(new)
    raise RuntimeError(f"paths are longer than {rounds}")


def simple_paths(edges: DataFrame, starts: DataFrame, sinks: DataFrame, most: int = 10) -> DataFrame:
    """``(start, sink, path)``: paths of at most ``most`` nodes that repeat none; a path carries its nodes, so cycles end."""
    session.ensure_checkpoint_dir(edges.sparkSession)
    paths = starts.select("start", F.col("start").alias("node"), F.array("start").alias("path"))
    every = paths
    for _ in range(most - 1):
        joined = paths.join(session.shuffled(edges.select("src", "dst")), F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        paths = joined.select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")).checkpoint()
        if paths.isEmpty():
            break
        every = every.unionByName(paths)
    return every.join(session.shuffled(sinks.select(F.col("sink").alias("node")).distinct()), "node").select("start", F.col("node").alias("sink"), "path")


def taint(flows: DataFrame, sources: DataFrame, sanitizers: DataFrame, rounds: int = 10) -> DataFrame:
    """``(node, label, hops)``: nodes that a labelled source reaches over ``flows(src, dst)`` without passing a sanitizer, with
    the label that comes first (fewest hops, then smallest label); at most ``rounds`` hops."""
    session.ensure_checkpoint_dir(flows.sparkSession)
    clean = sanitizers.select(F.col("node").alias("dst")).distinct()
    open_flows = session.shuffled(flows.select("src", "dst").join(session.shuffled(clean), "dst", "left_anti").checkpoint())
    known = sources.groupBy("node").agg(F.min("label").alias("label")).select("node", "label", F.lit(0).alias("hops")).checkpoint()
    new = known
    for hop in range(1, rounds + 1):
        step = new.join(open_flows, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("label"))
        new = step.join(session.shuffled(known.select("node")), "node", "left_anti").select("node", "label", F.lit(hop).alias("hops")).checkpoint()
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known
