"""One row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order_cols: list[str | Column]) -> DataFrame:
    """Of the rows of a key, that with the largest ``order_cols``; ties go by a hash of the row, so any partitioning gives the same.

    Spark keeps one row of a key in each task before the shuffle (window group limit), so a hot key is cut down first.
    """
    rest = [c for c in df.columns if c not in keys]
    order = [F.desc(c) for c in order_cols] + [F.desc(F.xxhash64(*rest))]
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """(rows, keys, duplicates): what de-duplication collapses."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), (F.sum("n") - F.count("*")).alias("duplicates"))
