"""Audits: nothing lost, nothing counted twice, joins that match, tables that agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import canonical_text, portable_hash


def row_conservation(raw: DataFrame, passed: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """One row: raw rows = duplicates + passed + rejected, and the keys of both halves beside the raw keys.

    The counts alone would agree by construction; ``keys_in_both`` and ``keys_lost`` are independent of them.
    """
    sides = passed.select(F.col(key).alias("_k"), F.lit(1).alias("p"), F.lit(0).alias("q")).unionByName(rejected.select(F.col(key).alias("_k"), F.lit(0).alias("p"), F.lit(1).alias("q")))
    sides = sides.unionByName(raw.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n")).select("_k", F.lit(0).alias("p"), F.lit(0).alias("q"), "n"), allowMissingColumns=True)
    keys = sides.groupBy("_k").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    one = keys.agg(
        F.sum("n").alias("raw_rows"), F.count("n").alias("raw_keys"), F.sum("p").alias("passed"), F.sum("q").alias("rejected"),
        F.sum(((F.col("p") > 0) & (F.col("q") > 0)).cast("int")).alias("keys_in_both"), F.sum((F.col("p") + F.col("q") == 0).cast("int")).alias("keys_lost"),
    )
    duplicates = F.col("raw_rows") - F.col("raw_keys")
    return one.select("raw_rows", duplicates.alias("duplicates"), "passed", "rejected", "keys_in_both", "keys_lost", (F.col("raw_rows") == duplicates + F.col("passed") + F.col("rejected")).alias("conserved"))


def join_coverage(name: str, joined: DataFrame, probe: str, key: str, fact_rows: DataFrame | None = None) -> DataFrame:
    """(join_name, joined_rows, matched, unmatched, keys_matched, match_rate) of a left join whose match sets ``probe``."""
    hit = F.col(probe).isNotNull()
    out = joined.agg(F.count("*").alias("joined_rows"), F.count(F.when(hit, 1)).alias("matched"), F.countDistinct(F.when(hit, F.col(key))).alias("keys_matched"))
    return out.select(F.lit(name).alias("join_name"), "joined_rows", "matched", (F.col("joined_rows") - F.col("matched")).alias("unmatched"), "keys_matched", F.try_divide(F.col("matched").cast("double"), F.col("joined_rows").cast("double")).alias("match_rate"))


def reconcile(a: DataFrame, b: DataFrame, measure: str) -> DataFrame:
    """One row: rows and sums of both frames, their differences, and whether both are zero."""
    of = lambda f, s: f.agg(F.count("*").alias(f"rows_{s}"), F.sum(F.col(measure).cast("decimal(18,2)")).alias(f"total_{s}"))
    both = of(a, "a").crossJoin(of(b, "b"))
    out = both.withColumns({"row_variance": F.col("rows_a") - F.col("rows_b"), "total_variance": (F.col("total_a") - F.col("total_b")).cast("double")})
    return out.withColumns({"total_a": F.col("total_a").cast("double"), "total_b": F.col("total_b").cast("double"), "reconciled": (F.col("row_variance") == 0) & (F.col("total_variance") == 0)})


def dq_metrics(run_log: DataFrame) -> DataFrame:
    """(dataset, update_id, passed, failed, pass_rate) from cumulative counters (dataset, update_id, batch_id, passed, failed).

    A batch reports its running totals several times: its largest counts, then batches add up.
    """
    batch = run_log.groupBy("dataset", "update_id", "batch_id").agg(F.max("passed").alias("passed"), F.max("failed").alias("failed"))
    out = batch.groupBy("dataset", "update_id").agg(F.sum("passed").alias("passed"), F.sum("failed").alias("failed"))
    return out.withColumn("pass_rate", F.try_divide(F.col("passed").cast("double"), (F.col("passed") + F.col("failed")).cast("double")))


def parse_run_log(events: DataFrame) -> DataFrame:
    """Run events (event_type, origin struct, details JSON) -> one row for each expectation reported."""
    kind = "array<struct<name:string,dataset:string,passed:bigint,failed:bigint>>"
    rows = events.where("event_type = 'flow_progress'").select("origin.update_id", "origin.batch_id", F.explode(F.from_json(F.get_json_object("details", "$.expectations"), kind)).alias("e"))
    return rows.select("update_id", "batch_id", "e.name", "e.dataset", "e.passed", "e.failed")


def failures_by_rule(run_log: DataFrame) -> DataFrame:
    """(dataset, failures map<rule, count>) of the rules that failed, each batch at its largest count."""
    batch = run_log.groupBy("dataset", "name", "update_id", "batch_id").agg(F.max("failed").alias("failed"))
    rule = batch.groupBy("dataset", "name").agg(F.sum("failed").alias("failed"))
    return rule.groupBy("dataset").agg(F.map_from_entries(F.collect_list(F.when(F.col("failed") > 0, F.struct("name", "failed")))).alias("failures"))


def failures_by_run(run_log: DataFrame) -> DataFrame:
    """(dataset, update_id, failures map<rule, count>), each batch at its largest count; rules that nothing failed are left out."""
    batch = run_log.groupBy("dataset", "update_id", "name", "batch_id").agg(F.max("failed").alias("failed"))
    rule = batch.groupBy("dataset", "update_id", "name").agg(F.sum("failed").alias("failed"))
    return rule.groupBy("dataset", "update_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("failed") > 0, F.struct("name", "failed")))).alias("failures"))


def run_quality(run_log: DataFrame) -> DataFrame:
    """``dq_metrics`` of each run with the failures of its rules; a run without either side is left out."""
    return dq_metrics(run_log).join(failures_by_run(run_log), ["dataset", "update_id"])


def append_run(metrics: DataFrame, update_id: int, path: str) -> None:
    """Adds a run's metrics to the series at ``path`` under its own folder, so that a run reported again replaces itself."""
    metrics.where(F.col("update_id") == update_id).drop("update_id").write.mode("overwrite").parquet(f"{path}/update_id={update_id}")


def table_checksum(df: DataFrame, portable: bool = False) -> DataFrame:
    """(rows, checksum) that do not hang on the order of rows; ``portable`` is slower, and any SQL engine can follow it."""
    if portable:
        own = portable_hash(F.concat_ws("|", *(canonical_text(c, t) for c, t in df.dtypes)))
    else:
        own = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("rows"), F.sum(own.cast("decimal(38,0)")).alias("checksum"))


def same_after_rerun(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: rows and checksums of two outputs of one job, and whether they agree."""
    both = table_checksum(first).crossJoin(table_checksum(second).select(F.col("rows").alias("rows_again"), F.col("checksum").alias("checksum_again")))
    return both.select("rows", "rows_again", F.col("checksum").eqNullSafe(F.col("checksum_again")).alias("same"))


def two_way_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either frame that the other lacks, repeats counted, with ``side``."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def expect(df: DataFrame, name: str, predicates: dict[str, str]) -> tuple[DataFrame, object]:
    """(df, Observation): counts rows and failures of each predicate while the frame is computed for something else."""
    from pyspark.sql import Observation

    seen = Observation(name)
    counts = [F.count(F.lit(1)).alias("rows")] + [F.count(F.when(F.expr(f"({p}) IS FALSE"), 1)).alias(k) for k, p in predicates.items()]
    return df.observe(seen, *counts), seen


def fail_on(df: DataFrame, predicate: str, message: str) -> DataFrame:
    """df, whose computation stops at the first row of which the predicate is false."""
    return df.where(F.when(F.expr(f"({predicate}) IS FALSE"), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))
