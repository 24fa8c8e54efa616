"""Profiles of tables in one pass, coverage gaps, run summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, rows, blanks, distinct_values, low, high): low and high of numbers only.

    Each column is grouped by its values, and the groups are counted: one aggregate of several distinct counts would send each
    row on once for every column, with all of them, and a task would hold as much. The frame is read once for each column.
    """
    kinds = dict(df.dtypes)
    parts = []
    for c in columns or df.columns:
        text = kinds[c] == "string"
        v, n = F.col("v"), F.col("n")
        blank = v.isNull() | (F.trim(v) == "") if text else v.isNull()
        number = kinds[c] in ("int", "bigint", "smallint", "tinyint", "double", "float") or kinds[c].startswith("decimal")
        value = v.cast("double") if number else F.lit(None).cast("double")
        total = lambda x: F.coalesce(F.sum(x), F.lit(0))
        of = df.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(of.agg(total(n).alias("rows"), total(F.when(blank, n)).alias("blanks"), F.count(v).alias("distinct_values"), F.min(value).alias("low"), F.max(value).alias("high")).select(F.lit(c).alias("column_name"), "*"))
    return reduce(DataFrame.unionByName, parts)


def coverage_gap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys of a, of b, and of a that b lacks."""
    left, right = a.select(key).where(F.col(key).isNotNull()).distinct(), b.select(key).distinct().withColumn("_b", F.lit(1))
    both = left.withColumn("_a", F.lit(1)).join(right, key, "full")
    return both.agg(F.count("_a").alias("keys_a"), F.count("_b").alias("keys_b"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNull(), 1)).alias("missing_in_b"))


def run_summary(runs: DataFrame, warm_up: int = 1) -> DataFrame:
    """(variant, runs, median_ms, spread) of rows (variant, run_no, ms), the first ``warm_up`` runs of each left out."""
    kept = runs.where(F.col("run_no") > warm_up)
    mid = F.percentile("ms", 0.5)
    return kept.groupBy("variant").agg(F.count("*").alias("runs"), mid.alias("median_ms"), F.try_divide((F.max("ms") - F.min("ms")).cast("double"), mid).alias("spread"))


def run_ratios(runs: DataFrame, warm_up: int = 1) -> DataFrame:
    """(variant, busy_ratio, cache_ratio) of rows (variant, run_no, ms, task_ms, cached_bytes, read_bytes), warm-up left out.

    busy_ratio: median task time over median run time, the cores kept busy; cache_ratio: bytes from the cache of all bytes read.
    """
    kept = runs.where(F.col("run_no") > warm_up)
    both = F.sum("cached_bytes").cast("double"), (F.sum("cached_bytes") + F.sum("read_bytes")).cast("double")
    return kept.groupBy("variant").agg(F.try_divide(F.percentile("task_ms", 0.5), F.percentile("ms", 0.5)).alias("busy_ratio"), F.try_divide(*both).alias("cache_ratio"))


def score_gate(scores: DataFrame, thresholds: dict[str, float], by: str | None = None) -> DataFrame:
    """(group, dimension, mean_score, threshold, passed) for each dimension column of scores."""
    group = F.col(by) if by else F.lit("all")
    long = scores.select(group.alias("category"), F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("s"), F.lit(t).alias("threshold")) for d, t in thresholds.items()))).alias("x"))
    out = long.groupBy("category", "x.dimension", "x.threshold").agg(F.sum(F.col("x.s").cast("decimal(18,4)")).cast("double").alias("t"), F.count("x.s").alias("n"))
    out = out.withColumn("mean_score", F.try_divide("t", F.col("n").cast("double")))
    return out.select("category", "dimension", "mean_score", "threshold", (F.col("mean_score") >= F.col("threshold")).alias("passed"))
