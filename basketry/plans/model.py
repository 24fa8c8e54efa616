"""Scores and gates of binary classifiers, and a boosted-tree classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import running_sums


def _by_score(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """(by, s, n, pos) of each distinct score, with running sums tp and all from the highest down, and totals positives and negatives.

    Ties are one row. Scores are dealt by range, so that no task orders them all.
    """
    seen = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    per = seen.groupBy(*by, F.col(score).cast("double").alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    summed = running_sums(per, [*by, F.desc("s")], ["n", "pos"])
    total = summed.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum(F.col("n") - F.col("pos")).alias("negatives"), F.min("before_n").alias("n0"), F.min("before_pos").alias("pos0"))
    both = summed.join(F.broadcast(total), by) if by else summed.crossJoin(F.broadcast(total))
    return both.withColumns({"tp": F.col("before_pos") - F.col("pos0") + F.col("pos"), "all": F.col("before_n") - F.col("n0") + F.col("n")})


def average_precision(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """The sum over distinct scores of recall gained times precision there: one row, or one for each group, of which there are few."""
    by = by or []
    each = _by_score(df, label, score, by).select(*by, (F.try_divide("pos", "positives") * F.col("tp") / F.col("all")).alias("x"))
    return each.groupBy(*by).agg(F.round(F.sum("x"), 6).alias("average_precision"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the chance that a positive is above a negative, ties counting half."""
    neg = F.col("n") - F.col("pos")
    below = F.col("negatives") - (F.col("all") - F.col("tp"))
    each = _by_score(df, label, score, []).select(F.try_divide(F.col("pos") * (below + neg / 2), F.col("positives") * F.col("negatives")).alias("x"))
    return each.agg(F.round(F.sum("x"), 6).alias("roc_auc"))


def lift_gate(model: DataFrame, baseline: DataFrame, metric: str, required: float = 0.10) -> DataFrame:
    """One row: both scores, relative lift, and whether it reaches what is required."""
    both = model.select(F.col(metric).alias("model_score")).crossJoin(baseline.select(F.col(metric).alias("baseline_score")))
    return both.withColumn("lift", F.round(F.try_divide(F.col("model_score") - F.col("baseline_score"), F.col("baseline_score")), 6)).withColumn("passed", F.col("lift") >= required)


def fit_gbt(train: DataFrame, features: list[str], label: str, seed: int = 7):
    """A pipeline of imputation, assembly and gradient-boosted trees, fitted by Spark."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler

    doubles = train.withColumns({f: F.col(f).cast("double") for f in features}).withColumn(label, F.col(label).cast("double"))
    filled = [f"{f}_filled" for f in features]
    stages = [Imputer(inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol=label, maxIter=20, maxDepth=4, seed=seed)]
    return Pipeline(stages=stages).fit(doubles)


def scored(model, rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """rows with score: the chance of label 1 that a fitted pipeline gives."""
    from pyspark.ml.functions import vector_to_array

    doubles = rows.withColumns({f: F.col(f).cast("double") for f in features}).withColumn(label, F.col(label).cast("double"))
    return model.transform(doubles).select(*rows.columns, F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def score_decay(df: DataFrame, label: str, score: str, period: str) -> DataFrame:
    """(period, average_precision, decay): decay is the difference from the first period."""
    each = average_precision(df, label, score, [period])
    first = each.agg(F.min_by("average_precision", period).alias("_first"))
    return each.crossJoin(F.broadcast(first)).select(period, "average_precision", F.round(F.col("average_precision") - F.col("_first"), 6).alias("decay"))


def importance(model, features: list[str], top: int = 8) -> DataFrame:
    """(feature, importance) of the most important features."""
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)
