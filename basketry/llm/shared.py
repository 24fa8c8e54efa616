"""Helpers that the operators of this subpackage share: the shared folder, materialising, splits and table reads."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch sent to a Python worker. Texts are a few kB on average and a few hundred kB at most.
ARROW_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or set on the context; without one, a temporary folder on local Spark only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Have the file system delete ``path`` when the driver's JVM ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def settle(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept as Parquet in the shared folder.

    Later reads start from those files, so a lost executor costs no recomputation of what lies before. The files
    go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    gone_at_exit(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Allocator settings of Python workers: what a batch took goes back to the system, as workers live on from stage to stage.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "262144"}


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, and between its tasks."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)


def with_fields(docs: DataFrame, made: Column, names: list[str]) -> DataFrame:
    """docs and the fields of a struct column; columns of docs with one of the names are replaced, whatever else they are called."""
    own = docs.select(F.struct("*").alias("row"), made.alias("made"))
    return own.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in names), *(F.col("made").getField(n).alias(n) for n in names))


def ascii_lower(text: Column | str) -> Column:
    """The text with A to Z in lower case and nothing else changed; null stays null."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the decimal text of ``doc_id``, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def in_fold(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether a row is in the held-out fold; a row without an id is not."""
    return F.coalesce(fold(doc_id, modulus) == remainder, F.lit(False))
