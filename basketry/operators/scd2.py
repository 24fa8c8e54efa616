"""Versioned dimensions with half-open windows, and joins to the version in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "valid_from", "valid_to"


def valid_at(at: Column, start: Column, end: Column) -> Column:
    """start <= at < end, where a null end is open."""
    return (at >= start) & (end.isNull() | (at < end))


def build_scd2(changes: DataFrame, keys: list[str], sequence: str, tracked: list[str], tie_break: list[str] | None = None) -> DataFrame:
    """Versions of a change feed: re-deliveries that change nothing are folded, each version ends where the next starts.

    Changes may come in any order. Of changes with the same sequence value the largest by ``tie_break`` (else by the
    tracked columns) counts, so no window has zero length.
    """
    order = F.struct(*(tie_break or tracked))
    one = changes.groupBy(*keys, sequence).agg(F.max_by(F.struct(*tracked), order).alias("_v"))
    by_key = Window.partitionBy(*keys).orderBy(sequence)
    one = one.withColumns({"_n": F.row_number().over(by_key), "_before": F.lag("_v").over(by_key)})
    kept = one.where((F.col("_n") == 1) | ~F.col("_v").eqNullSafe(F.col("_before")))
    kept = kept.withColumn(END, F.lead(sequence).over(by_key))
    return kept.select(*keys, *(F.col(f"_v.{c}").alias(c) for c in tracked), F.col(sequence).alias(START), END, F.col(END).isNull().alias("is_current"))


def snapshot_versions(snapshot: DataFrame, keys: list[str], versions: list[Column]) -> DataFrame:
    """A change feed from a snapshot: a row for each of the version structs that is not null, which a row has one to n of."""
    rows = snapshot.select(*keys, F.explode(F.array_compact(F.array(*versions))).alias("_v"))
    return rows.select(*keys, "_v.*")


def as_of_join(facts: DataFrame, dim: DataFrame, keys: list[str], at: str, how: str = "left", select: list[str] | None = None) -> DataFrame:
    """Facts with the chosen columns of the version in force at ``at``: an equi join with the window as residual.

    left keeps facts before the first version, with nulls; inner drops them. Columns of the dimension that clash with
    a fact's are not taken.
    """
    wanted = [c for c in (select or [c for c in dim.columns if c not in keys]) if c not in facts.columns]
    d = dim.select(*(F.col(k).alias(f"_d_{k}") for k in keys), F.col(START).alias("_start"), F.col(END).alias("_end"), *(F.col(c).alias(f"_v_{c}") for c in wanted))
    on = valid_at(F.col(at), F.col("_start"), F.col("_end"))
    for k in keys:
        on = (F.col(k) == F.col(f"_d_{k}")) & on
    return facts.join(d, on, how).select(*facts.columns, *(F.col(f"_v_{c}").alias(c) for c in wanted))


def orphans(facts: DataFrame, dim: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Facts without a version in force."""
    probe = dim.withColumn("_probe", F.lit(1))
    return as_of_join(facts, probe, keys, at, "left", ["_probe"]).where("_probe is null").drop("_probe")


def fanout_report(facts: DataFrame, dim: DataFrame, keys: list[str], at: str, measure: str) -> DataFrame:
    """(join_kind, rows, total): what joining on the key alone does to rows and sums, beside the point-in-time join."""
    naive = facts.join(dim.select(*keys), keys)
    exact = as_of_join(facts, dim, keys, at, "inner", [])
    sums = [F.count("*").alias("rows"), F.sum(F.col(measure).cast("decimal(18,2)")).cast("double").alias("total")]
    return naive.agg(*sums).select(F.lit("key_only").alias("join_kind"), "*").unionByName(exact.agg(*sums).select(F.lit("point_in_time").alias("join_kind"), "*"))


def overlapping_windows(dim: DataFrame, keys: list[str]) -> DataFrame:
    """Versions that begin before an earlier version of their key has ended, next to it or not.

    One pass over the versions of a key in order with a running maximum of ends, not a self-join.
    """
    before = Window.partitionBy(*keys).orderBy(START, END).rowsBetween(Window.unboundedPreceding, -1)
    far = F.lit("9999-12-31").cast("timestamp")
    reach = F.max(F.coalesce(F.col(END), far)).over(before)
    return dim.withColumn("reaches", reach).where(F.col(START) < F.col("reaches"))


def open_version_violations(dim: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that do not have exactly one open version, with how many they have: none, or several."""
    per_key = dim.groupBy(*keys).agg(F.count("*").alias("_versions"), F.count(END).alias("_ended"))
    return per_key.withColumn("open_versions", F.col("_versions") - F.col("_ended")).where("open_versions <> 1").drop("_versions", "_ended")
