"""Layouts that scans and joins can use: rows clustered on several keys with an index of files, and tables bucketed alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of each key in an interleaved key: so many halvings of its values.
BITS = 8


def edges_of(df: DataFrame, keys: list[str], bits: int = BITS) -> dict[str, list]:
    """For each key the values that cut its rows into 2^bits parts of about equal size, by one pass; nulls are left out."""
    n = 1 << bits
    cuts = df.agg(*(F.percentile_approx(k, [i / n for i in range(1, n)], 10 * n).alias(k) for k in keys)).first()
    return {k: sorted(set(cuts[k] or [])) for k in keys}


def part_of(column: Column, edges: list) -> Column:
    """How many edges lie before a value, found by halves; 0 for null."""
    if not edges:
        return F.lit(0)
    cuts, steps = F.array(*map(F.lit, edges)), F.array(*(F.lit(1 << b) for b in reversed(range(len(edges).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(cuts, at + step - 1) < column, F.lit(False)), at + step).otherwise(at))


def z_key(parts: list[Column], bits: int = BITS) -> Column:
    """The bits of several numbers by turns, the highest first: near in the key is near in all of them."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for i, part in enumerate(parts):
            bit = F.shiftright(part.cast("long"), b).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit, b * len(parts) + len(parts) - 1 - i))
    return out


def write_z_ordered(df: DataFrame, path: str, keys: list[str], files: int, bits: int = BITS) -> None:
    """Rows in ranges of the interleaved ranks of all keys, so that a range of any of them lies in few files."""
    edges = edges_of(df, keys, bits)
    # a key of few values is spread over the whole range too, or its bits would come after all of the other's
    parts = [F.floor(part_of(F.col(k), edges[k]) * (1 << bits) / (len(edges[k]) + 1)) for k in keys]
    keyed = df.withColumn("_z", z_key(parts, bits))
    keyed.repartitionByRange(files, "_z").sortWithinPartitions("_z", *keys).drop("_z").write.mode("overwrite").parquet(path)


def write_file_index(spark: SparkSession, path: str, keys: list[str], target: str) -> None:
    """(file, rows, and for each key low_<key>, high_<key>) of a Parquet folder, as a table beside it: a row for each file."""
    ends = [f(k).alias(f"{n}_{k}") for k in keys for n, f in (("low", F.min), ("high", F.max))]
    spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), *ends).write.mode("overwrite").parquet(target)


def files_for(index: DataFrame, ranges: dict[str, tuple]) -> list[str]:
    """Files of an index that may hold rows within all of the closed ranges, chosen before any is opened."""
    for k, (low, high) in ranges.items():
        index = index.where((F.col(f"high_{k}") >= F.lit(low)) & (F.col(f"low_{k}") <= F.lit(high)))
    return sorted(r["file"] for r in index.select("file").collect())


def read_range(spark: SparkSession, path: str, index: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """Rows within the ranges, from the files that the index names only."""
    whole, files = spark.read.parquet(path), files_for(index, ranges)
    rows = spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0)
    for k, (low, high) in ranges.items():
        rows = rows.where(F.col(k).between(F.lit(low), F.lit(high)))
    return rows


def write_bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """df as an external table at ``path``, hashed on the keys into buckets of one sorted file each.

    Tables of the same buckets on the same keys are joined without a shuffle. The table's name is only needed while it is
    opened: what is returned reads the files.
    """
    spark = df.sparkSession
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).mode("overwrite").saveAsTable(table)
    return spark.table(table)
