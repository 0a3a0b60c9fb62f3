"""Clusters of findings within a category, and what to say about them."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos import schema, session
from pelagos.functions import scalars as S


#: Characters that types and messages of a pair may have together for its verdict to be remembered.
REMEMBERED = 600


def _parts(row: tuple) -> tuple:
    """Type and message in lower case, as they are compared, and the file."""
    return (row[0] or "").lower(), (row[1] or "").lower(), row[2]


def _reaches(a: tuple, b: tuple, least: float) -> bool:
    """Whether 0.3 type, 0.3 message, 0.2 file and 0.2 category come to ``least``. Bounds first: by lengths, then by letters;
    matching blocks are looked for only where both leave it open, and for the message only if the type leaves it open. Pairs of
    long texts are compared each time, so that what is remembered stays small."""
    judged = _comes_to if sum(map(len, (*a[:2], *b[:2]))) <= REMEMBERED else _comes_to.__wrapped__
    return judged(a[:2], b[:2], bool(a[2] and a[2] == b[2]), least)


@lru_cache(1 << 16)
def _comes_to(a: tuple, b: tuple, same_file: bool, least: float) -> bool:
    """``_reaches``, remembered over files: types and messages repeat in them."""
    rest = 0.2 * same_file + 0.2
    pairs = [SequenceMatcher(None, a[i], b[i], autojunk=False) for i in (0, 1)]  # all letters count, however long a text is
    for bound in ("real_quick_ratio", "quick_ratio"):
        if 0.3 * getattr(pairs[0], bound)() + 0.3 * getattr(pairs[1], bound)() + rest < least - 1e-9:
            return False
    kind = pairs[0].ratio()
    if 0.3 * kind + 0.3 * pairs[1].quick_ratio() + rest < least - 1e-9:
        return False
    return 0.3 * kind + 0.3 * pairs[1].ratio() + rest >= least


def sub_clusters(findings: DataFrame, least: float = 0.7, within: str = "file") -> DataFrame:
    """``(ord, cluster)``: in order of arrival, a finding joins the first cluster of its category and ``within`` whose first
    finding is similar enough (0.3 type, 0.3 message, 0.2 file if there is one, 0.2 category); ``cluster`` is that first finding.

    Findings equal in type, message and file score alike and are one row here, so a group is as large as its *different*
    findings; sorted partitions are read row by row and only a group's first findings are held.
    """
    base = findings.select("ord", S.category(F.col("type")).alias("category"), F.col(within).alias("within"), "type", "message", "file")
    by = ["category", "within", "type", "message", "file"]
    kinds = base.groupBy(*by).agg(F.min("ord").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchors = None, []
        for batch in batches:
            out = []
            for category, part, first, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (category, part) != last:
                    last, anchors = (category, part), []
                own = _parts(tuple(row))
                found = next((a for a in anchors if _reaches(own, a[1], least)), None)
                if found is None:
                    anchors.append(found := (first, own))
                out.append(found[0])
            yield pa.record_batch([batch.column(i) for i in (0, 1, 3, 4, 5)] + [pa.array(out, pa.int64())], [*by, "cluster"])

    n = int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kinds.repartition(n, "category", "within").sortWithinPartitions("category", "within", "first").select("category", "within", "first", "type", "message", "file")
    named = session.shuffled(dealt.mapInArrow(run, kinds.select(*by, F.col("first").cast("long").alias("cluster")).schema))
    on = [base[c].eqNullSafe(named[c]) for c in by]
    return base.join(named, on).select("ord", "cluster")


def summary(findings: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per cluster: size, worst severity, files, confidence of its size."""
    rank = S.lookup(schema.SEVERITY_ORDER, F.lower("severity"), 0)
    return findings.join(clusters, "ord").groupBy("cluster").agg(
        F.count("*").alias("n"), F.max(rank).alias("worst"), F.count_distinct("file").alias("files"),
        F.bround(F.least(F.lit(0.99), 0.5 + 0.1 * F.least(F.count("*"), F.lit(5))), 6).alias("confidence"),
    )


def effort(files: Column, findings: Column) -> Column:
    """Hours that a cluster takes, by how many files and findings it has."""
    return (
        F.when((files <= 1) & (findings <= 2), "low").when((files <= 3) & (findings <= 5), "medium").when((files <= 5) & (findings <= 10), "high").otherwise("very high")
    )
