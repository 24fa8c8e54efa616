"""Structured Streaming flows: upserts without a table format, versioned dimensions, windows, late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from ..operators.dedupe import latest_per_key
from ..operators.scd2 import build_scd2


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _holds(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def _promote(staged: DataFrame, path: str) -> None:
    """Puts staged buckets in place of the table's; not atomic, so it is done again if it is cut short."""
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def recover(spark: SparkSession, path: str) -> None:
    """Promotes again what was staged and marked as whole, if a run died while it did so; every writer begins with this."""
    mark, fs = _fs(spark, f"{path}_staging/_whole")
    if fs.exists(mark):
        _promote(spark.read.parquet(f"{path}_staging/rows"), path)
        fs.delete(mark, False)


def _replace_buckets(spark: SparkSession, merged: DataFrame, path: str) -> None:
    """Writes the touched buckets beside the target, marks them as whole, and promotes them.

    A run that dies before the mark leaves the table as it was; one that dies after it leaves all that ``recover`` needs.
    """
    merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}_staging/rows")
    mark, fs = _fs(spark, f"{path}_staging/_whole")
    fs.create(mark, True).close()
    recover(spark, path)


def _bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.hash(*keys), F.lit(buckets)))


def _touched(rows: DataFrame) -> list[int]:
    """The buckets of rows, of which there are at most as many as the table has."""
    return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())


def merge_batch(batch: DataFrame, path: str, keys: list[str], order_cols: list[str], buckets: int) -> None:
    """Puts the latest row of each key in ``path``, Parquet by bucket; only buckets with changes are read and replaced.

    One writer at a time. An empty batch changes nothing.
    """
    spark = batch.sparkSession
    recover(spark, path)
    new = _bucketed(latest_per_key(batch, keys, order_cols), keys, buckets)
    touched = _touched(new)
    if not touched:
        return
    if _holds(spark, path):
        old = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
        new = _bucketed(latest_per_key(old.drop("bucket").unionByName(new.drop("bucket")), keys, order_cols), keys, buckets)
    _replace_buckets(spark, new, path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table by bucket."""
    return spark.read.parquet(path).drop("bucket")


def upsert_stream(stream: DataFrame, path: str, keys: list[str], order_cols: list[str], checkpoint: str, buckets: int = 16) -> None:
    """Drains a stream into a table of the latest row of each key; a replay at any lag changes nothing.

    A batch rewrites the buckets that it touches, so their number should grow with the table: some hundred MB a bucket.
    """
    write = lambda batch, _: merge_batch(batch, path, keys, order_cols, buckets)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def scd2_stream(stream: DataFrame, log_path: str, dim_path: str, keys: list[str], sequence: str, tracked: list[str], checkpoint: str, buckets: int = 16) -> None:
    """Drains changes into a log, and rebuilds the versions of the keys' buckets that changed; late changes fall into place.

    A batch only adds its own folder to the log, under its number, so a batch that runs again overwrites what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        recover(spark, dim_path)
        new = _bucketed(batch.select(*keys, sequence, *tracked).distinct(), keys, buckets)
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{log_path}/batch={number}")
        if touched := _touched(new):
            log = spark.read.schema(StructType(new.schema.fields).add("batch", LongType())).option("basePath", log_path).parquet(log_path)
            log = log.where(F.col("bucket").isin(touched)).drop("bucket", "batch")
            _replace_buckets(spark, _bucketed(build_scd2(log, keys, sequence, tracked), keys, buckets), dim_path)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def split_stream(stream: DataFrame, rules: list, valid_path: str, rejected_path: str, checkpoint: str) -> None:
    """Both halves of a gate from one batch, so that they cannot come apart."""
    from ..operators.rules import gate

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            valid, rejected = gate(batch, rules)
            valid.write.mode("overwrite").parquet(f"{valid_path}/batch={number}")
            rejected.write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")
        finally:
            batch.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def start_drain(rows: DataFrame, path: str, checkpoint: str, mode: str = "append", name: str | None = None) -> StreamingQuery:
    """Starts a streaming frame over what is there into Parquet; it ends by itself."""
    writer = rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def start_live(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Starts a streaming frame into Parquet; it takes what comes until it is stopped."""
    return rows.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).start()


def drain(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a streaming frame over what is there into Parquet."""
    start_drain(rows, path, checkpoint, mode).awaitTermination()


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Drains a stream into ``write(batch, number)``; a batch that runs again has its number again."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed(stream: DataFrame, ts: str, window: str, keys: list[str], value: str, delay: str = "6 hours", slide: str | None = None, session: bool = False) -> DataFrame:
    """Tumbling, sliding or session windows of a stream with a watermark: count and sum of value."""
    when = F.session_window(ts, window) if session else F.window(ts, window, slide) if slide else F.window(ts, window)
    out = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(when.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", F.col("total").cast("double").alias("total"))


def upsert_windows(rows: DataFrame, path: str, keys: list[str], checkpoint: str, buckets: int = 16) -> None:
    """Drains windows in update mode into a table by bucket: a window that changed replaces itself, one that is closed leaves the state."""
    write = lambda batch, _: merge_batch(batch, path, ["window_start", *keys], ["n"], buckets)
    rows.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def deduplicated(stream: DataFrame, keys: list[str], ts: str | None = None, delay: str | None = None) -> DataFrame:
    """The first row of each key: for all time, or within a watermark so that state is bounded."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys) if ts and delay else stream.dropDuplicates(keys)


def provisional(windows: DataFrame, peak: DataFrame, delay: str = "6 HOURS") -> DataFrame:
    """windows with is_provisional: whether rows may still come, as the window ends after the watermark (``peak``: one row, max_ts)."""
    return windows.crossJoin(F.broadcast(peak)).withColumn("is_provisional", F.col("window_end") > F.col("max_ts") - F.expr(f"INTERVAL {delay}")).drop("max_ts")


def split_late(stream: DataFrame, ts: str, delay: str, kept_path: str, late_path: str, peaks_path: str, checkpoint: str) -> None:
    """Drains a stream into rows in time and rows behind the largest event time of the batches before by more than ``delay``.

    That time is kept as one row for each batch; a batch that runs again sees the batches before it only, and overwrites its own.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        peak = None
        if number:
            seen = spark.read.schema("peak timestamp, batch bigint").option("basePath", peaks_path).parquet(peaks_path)
            peak = seen.where(F.col("batch") < number).agg(F.max("peak")).first()[0]
        late = F.lit(False) if peak is None else F.coalesce(F.col(ts) < F.lit(peak) - F.expr(f"INTERVAL {delay}"), F.lit(False))
        batch = batch.withColumn("_late", late).persist()
        try:
            batch.where("not _late").drop("_late").write.mode("overwrite").parquet(f"{kept_path}/batch={number}")
            batch.where("_late").drop("_late").write.mode("overwrite").parquet(f"{late_path}/batch={number}")
            batch.agg(F.max(ts).alias("peak")).write.mode("overwrite").parquet(f"{peaks_path}/batch={number}")
        finally:
            batch.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def late_rows(rows: DataFrame, batch: str, ts: str, delay: str) -> DataFrame:
    """rows with is_late: whether an event's time is behind the largest of the batches before by more than ``delay``.

    The window runs over batches, of which there are few, not over rows.
    """
    from pyspark.sql import Window

    peaks = rows.groupBy(batch).agg(F.max(ts).alias("_m"))
    before = peaks.select(batch, F.max("_m").over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)).alias("_seen"))
    out = rows.join(F.broadcast(before), batch)
    return out.withColumn("is_late", F.coalesce(F.col(ts) < F.col("_seen") - F.expr(f"INTERVAL {delay}"), F.lit(False))).drop("_seen")


def stream_batch_variance(stream: DataFrame, batch: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """(keys, streamed, batched, variance) of two aggregates; a side that lacks a key counts as zero."""
    both = stream.select(*keys, F.col(measure).alias("streamed")).join(batch.select(*keys, F.col(measure).alias("batched")), keys, "full").fillna(0, ["streamed", "batched"])
    return both.withColumn("variance", F.col("streamed") - F.col("batched"))
