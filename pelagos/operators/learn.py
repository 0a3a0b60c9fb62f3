"""Triage models on MLlib: features as columns, a boosted-tree classifier, its measure."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos import schema
from pelagos.functions import scalars as S


def features(findings: DataFrame) -> tuple[DataFrame, list[str]]:
    """Numeric columns of findings: severity, confidence, tool, place, message."""
    columns = {
        "x_severity": S.lookup(schema.SEVERITY_ORDER, F.lower("severity"), 0).cast("double"), "x_confidence": F.coalesce("confidence", F.lit(0.7)),
        "x_weight": S.lookup(schema.TOOL_WEIGHT, F.col("tool"), 0.5), "x_line": F.log1p(F.col("line").cast("double")), "x_message": F.length("message").cast("double"),
        "x_static": F.col("tool").isin("slither", "aderyn", "mythril").cast("double"),
    }
    return findings.withColumns(columns), list(columns)


def train(labelled: DataFrame, label: str = "label", held_out: float = 0.3, seed: int = 42) -> tuple[PipelineModel, float]:
    """The fitted model and its area under the curve on rows held out by a hash of ``ord``."""
    rows, names = features(labelled)
    test = F.pmod(F.xxhash64("ord", F.lit(seed)), F.lit(1000)) < int(1000 * held_out)
    steps = [VectorAssembler(inputCols=names, outputCol="features"), GBTClassifier(labelCol=label, maxIter=20, maxDepth=3, seed=seed)]
    model = Pipeline(stages=steps).fit(rows.where(~test))
    return model, BinaryClassificationEvaluator(labelCol=label).evaluate(model.transform(rows.where(test)))


def score(findings: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds ``p_real``; ranks, drops nothing."""
    rows, names = features(findings)
    kept = [c for c in findings.columns]
    return model.transform(rows).select(*kept, vector_to_array("probability")[1].alias("p_real"))


def heuristic_noise(findings: DataFrame) -> DataFrame:
    """Adds ``p_noise`` without a model: 0.3, and more for low severity (0.3), library code (0.2), no weakness number (0.1), a
    confidence under 0.5 (0.2) and arithmetic on a compiler that checks it (0.3); 1 at most.

    Of ``findings(severity, confidence, swc_id, has_library, checked_arithmetic)``.
    """
    plus = lambda test, x: F.when(F.coalesce(test, F.lit(False)), x).otherwise(0.0)
    low = S.lookup(schema.SEVERITY_ORDER, F.lower("severity"), 0) <= 1
    no_swc = F.coalesce("swc_id", F.lit("")) == ""
    score = 0.3 + plus(low, 0.3) + plus(F.col("has_library"), 0.2) + plus(no_swc, 0.1) + plus(F.coalesce("confidence", F.lit(0.5)) < 0.5, 0.2) + plus(F.col("checked_arithmetic"), 0.3)
    return findings.withColumn("p_noise", F.bround(F.least(F.lit(1.0), score), 6))
