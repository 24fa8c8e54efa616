"""Total order without a one-task sort."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Folders staged in this process and not released yet.
_STAGES: list[str] = []


def release_stages(spark: SparkSession) -> int:
    """Removes what queries have staged so far, and returns how many folders: frames made before read nothing any more.

    For sessions that run long; otherwise staged folders go when the driver's JVM ends.
    """
    gone = len(_STAGES)
    while _STAGES:
        folder = spark._jvm.org.apache.hadoop.fs.Path(_STAGES.pop())
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return gone


def stage_dir(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, named in ``spark.checkpoint.dir``; under a temporary one on local Spark only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        base = tempfile.mkdtemp(prefix="spark-stage-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base}/stage-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    _STAGES.append(path)
    return path


def padded_key(column: str, width: int) -> Column:
    """A number as a text key of twelve digits and ``width`` bytes more: the same order at a wider sort key."""
    return F.concat(F.lpad(F.col(column).cast("string"), 12, "0"), F.repeat(F.lit("x"), width))


def staged(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared folder: for frames that a query needs more than once."""
    path = f"{stage_dir(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sums(df: DataFrame, order_cols: list, columns: list[str], partitions: int | None = None) -> DataFrame:
    """df with ``before_<c>`` for each column: its sum over the rows before in the order, which should be total; 0 for the first.

    Rows are dealt by range and summed in their partition, written once so that both passes see the same partitions, and
    moved by the sums of the partitions before: a list as long as there are partitions.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order_cols).withColumn("_part", F.spark_partition_id())
    before = Window.partitionBy("_part").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    kept = staged(ranged.withColumns({f"_b_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in columns}))
    parts = kept.groupBy("_part").agg(*(F.sum(c).alias(f"_t_{c}") for c in columns))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = parts.select("_part", *(F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_s_{c}") for c in columns))
    out = kept.join(F.broadcast(start), "_part")
    return out.select(*df.columns, *((F.col(f"_b_{c}") + F.col(f"_s_{c}")).alias(f"before_{c}") for c in columns))


def distributed_row_number(df: DataFrame, order_cols: list, name: str = "row_number", partitions: int | None = None) -> DataFrame:
    """df with its 1-based place in the order, which should be total.

    Rows are dealt by range, sorted there and numbered in passing: the ids that Spark counts up within a partition are the
    places in it, so no second shuffle brings a range together. The sizes of the ranges before are added: a row for each range.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    out = placed.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(start), "_range")
    return out.select(*df.columns, place.alias(name))
