"""Ingest of drifting JSON lines: a schema registry beside the data, rescued fields, provenance; typed CSV; file upkeep."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class SchemaRegistry:
    """Versions of a schema as files ``<folder>/<n>``; each only adds fields."""

    def __init__(self, spark: SparkSession, folder: str, hints: dict[str, str] | None = None) -> None:
        self.spark, self.folder, self.hints = spark, folder, hints or {}

    def versions(self) -> int:
        path, fs = _fs(self.spark, self.folder)
        return len([s for s in fs.listStatus(path) if s.getPath().getName().isdigit()]) if fs.exists(path) else 0

    def current(self) -> dict[str, str]:
        n = self.versions()
        if not n:
            return {}
        return json.loads(self.spark.read.text(f"{self.folder}/{n - 1}", wholetext=True).first()[0])

    def evolve(self, names: list[str]) -> dict[str, str]:
        """Adds unseen names, typed by hint or as string, in a new version if there are any; hints are there from the first."""
        have = self.current()
        new = {n: self.hints.get(n, "string") for n in sorted({*names, *(self.hints if not have else ())}) if n not in have}
        if new:
            have = {**have, **new}
            path, fs = _fs(self.spark, f"{self.folder}/{self.versions()}")
            out = fs.create(path, False)
            out.write(bytearray(json.dumps(have).encode()))
            out.close()
        return have


def keys_of(lines: DataFrame, value: str = "value") -> list[str]:
    """Field names in JSON lines: as many as the schema has columns."""
    rows = lines.select(F.explode(F.map_keys(F.from_json(value, "map<string,string>"))).alias("k")).distinct()
    return sorted(r["k"] for r in rows.collect())


def typed(lines: DataFrame, schema: dict[str, str], value: str = "value", path: Column | None = None) -> DataFrame:
    """JSON lines as typed columns and ``_rescued_data``: what did not fit its type or the schema, with the file; a broken line whole.

    Other columns of lines are kept.
    """
    rest = [c for c in lines.columns if c != value]
    rows = lines.withColumn("_m", F.from_json(value, "map<string,string>"))
    columns = {n: F.col("_m")[n].try_cast(t) for n, t in schema.items()}
    unfit = [F.when(F.col("_m")[n].isNotNull() & c.isNull(), F.lit(n)) for n, c in columns.items()]
    lost = F.array_compact(F.array(*unfit)) if unfit else F.array().cast("array<string>")
    known = F.array(*map(F.lit, schema)) if schema else F.array().cast("array<string>")
    rows = rows.withColumn("_lost", lost)
    kept = F.map_filter("_m", lambda k, v: v.isNotNull() & (F.array_contains("_lost", k) | ~F.array_contains(known, k)))
    where = F.map_from_arrays(F.array(F.lit("_file_path")), F.array(path)) if path is not None else F.create_map().cast("map<string,string>")
    rescued = F.when(F.col("_m").isNull(), F.to_json(F.map_concat(F.create_map(F.lit("_line"), F.col(value)), where))).when(F.size(kept) > 0, F.to_json(F.map_concat(kept, where)))
    return rows.select(*rest, *(c.alias(n) for n, c in columns.items()), rescued.alias("_rescued_data"))


def provenance(run_id: str) -> dict[str, Column]:
    return {"_source_file": F.col("_metadata.file_path"), "_source_file_ts": F.col("_metadata.file_modification_time"), "_ingest_ts": F.current_timestamp(), "_pipeline_id": F.lit(run_id)}


def ingest(spark: SparkSession, landing: str, target: str, checkpoint: str, registry: SchemaRegistry, run_id: str, max_files: int = 1000) -> None:
    """Reads the files that have landed since the last run, once each, and appends them typed to ``target``.

    The schema is settled before each micro-batch is written. A batch that is run again overwrites its own folder.
    """
    stream = spark.readStream.option("maxFilesPerTrigger", max_files).text(landing).select("value", *(c.alias(n) for n, c in provenance(run_id).items()))

    def write(batch: DataFrame, number: int) -> None:
        schema = registry.evolve(keys_of(batch))
        typed(batch, schema, path=F.col("_source_file")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    """All batches; columns that a batch lacks are null."""
    return spark.read.option("mergeSchema", True).option("basePath", target).parquet(target)


def ingest_health(rows: DataFrame, exact: bool = True) -> DataFrame:
    """(source file) -> rows, rescued rows, ranges of event and ingest time, distinct users; ``exact`` false for an estimate at scale."""
    users = F.countDistinct("user_id") if exact else F.approx_count_distinct("user_id")
    return rows.groupBy("source_file").agg(F.count("*").alias("rows"), F.sum(F.col("rescued").cast("int")).alias("rescued_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("_ingest_ts").alias("first_ingest"), F.max("_ingest_ts").alias("last_ingest"), users.alias("users"))


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: T.StructType | str) -> None:
    """Typed CSV with a header as zstd Parquet; a value that does not fit its type fails the read."""
    spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(source).write.mode("overwrite").option("compression", "zstd").parquet(target)


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes, median_bytes) of a Parquet folder; the files' own metadata is read, one row of each."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"), F.percentile("file_size", 0.5).alias("median_bytes"))


def compact(spark: SparkSession, path: str, target: str, target_bytes: int = 128 << 20, floor_bytes: int = 16 << 20) -> bool:
    """The rows of ``path`` in files of about ``target_bytes`` in a new folder, which the caller swaps in.

    Returns whether the files are large enough: a median of ``floor_bytes``, or no more files than the target size asks for.
    """
    total = file_stats(spark, path).first()["bytes"] or 0
    wanted = max(1, -(-total // target_bytes))
    spark.read.parquet(path).repartition(wanted).write.mode("overwrite").parquet(target)
    now = file_stats(spark, target).first()
    return now["files"] <= wanted or now["median_bytes"] >= floor_bytes


def write_clustered(df: DataFrame, path: str, keys: list[str], files: int, file_rows: int = 1 << 20) -> None:
    """Rows in ranges of the keys, sorted in each file, so that file statistics prune scans on them.

    There are ``files`` files, or more where they would hold over ``file_rows`` rows or so: a task sorts one file.
    """
    files = max(files, -(-df.count() // file_rows))
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def baseline_copy(spark: SparkSession, source: str, target: str) -> DataFrame:
    """A table made straight from Parquet by a SQL select, in whatever files come out: what tuned layouts are measured against."""
    spark.sql("SELECT * FROM parquet.`" + source.replace("`", "``") + "`").write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def file_ranges(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(file, low, high) of a key in each file of a Parquet folder: what file statistics can prune by."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"))
