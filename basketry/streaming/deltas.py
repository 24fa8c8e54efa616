"""Tables that are merged when they are read: a batch only adds sorted files, and a compaction folds them into a new base."""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..operators.dedupe import latest_per_key
from ..operators.rank import staged
from .flows import _fs


def latest(keys: list[str], order_cols: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Merges by keeping the latest row of each key."""
    return lambda rows: latest_per_key(rows, keys, order_cols)


def summed(keys: list[str], totals: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Merges by adding up; a key whose totals are all zero is gone."""

    def merge(rows: DataFrame) -> DataFrame:
        out = rows.groupBy(*keys).agg(*(F.sum(c).cast(dict(rows.dtypes)[c]).alias(c) for c in totals))
        return out.where(F.greatest(*(F.abs(c) for c in totals)) > 0 if len(totals) > 1 else F.col(totals[0]) != 0)

    return merge


@contextmanager
def _dealt(spark: SparkSession, parts: int):
    """Shuffles planned in here have so many partitions: rows merged by key lie as they are dealt out by the same keys, and stay."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


class MergedTable:
    """Rows under ``path``: ``base/v=<n>``, ``deltas/batch=<n>`` and a manifest that says which base counts and what it covers.

    ``merge`` makes one row of the rows of a key, and may be applied to parts first. Base and deltas lie in
    ``of=<buckets>/bucket=<b>`` by a hash of the keys, sorted by them, so that looking up a key reads one bucket of each;
    a base has as many buckets as its size and rows ask for, and deltas as many as the base (before the first, ``buckets``, else one
    a core) or as their own rows ask for, if that is more: a task sorts one bucket, of ``bucket_rows`` or so. One writer at a time;
    readers go by the last whole manifest, and what it names stays until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], compact_after: int = 16, bucket_bytes: int = 128 << 20, buckets: int | None = None, bucket_rows: int = 1 << 20) -> None:
        self.spark, self.path, self.keys, self.merge = spark, path, keys, merge
        self.compact_after, self.bucket_bytes, self.bucket_rows = compact_after, bucket_bytes, bucket_rows
        self.buckets = buckets or min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    # ------------------------------------------------------------ what is there
    def _names(self, folder: str) -> list[str]:
        place, fs = _fs(self.spark, f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []

    def manifest(self) -> dict:
        """{version, covers, buckets}: the newest; before the first, no base covers batch -1."""
        versions = [int(n) for n in self._names("manifest") if n.isdigit()]
        if not versions:
            return {"version": 0, "covers": -1, "buckets": self.buckets}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{max(versions)}", wholetext=True).first()[0])

    def pending(self) -> list[int]:
        """Numbers of the whole batches that no base covers."""
        covers = self.manifest()["covers"]
        found = [int(n.removeprefix("batch=")) for n in self._names("deltas") if n.startswith("batch=")]
        whole = [n for n in found if n > covers and "_SUCCESS" in self._names(f"deltas/batch={n}")]
        return sorted(whole)

    def _folders(self) -> list[str]:
        now = self.manifest()
        base = [f"{self.path}/base/v={now['version']}"] if now["version"] else []
        return base + [f"{self.path}/deltas/batch={n}" for n in self.pending()]

    def _rows(self) -> DataFrame | None:
        """All rows that count, with ``of`` and ``bucket``; None before the first batch."""
        folders = self._folders()
        if not folders:
            return None
        own = StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema", wholetext=True).first()[0]))
        schema = own.add("of", IntegerType()).add("bucket", IntegerType())  # a batch whose rows cancel out has no file to tell
        frames = [self.spark.read.schema(schema).option("basePath", f).parquet(f) for f in folders]
        out = None
        for frame in frames:
            out = frame if out is None else out.unionByName(frame)
        return out

    # ------------------------------------------------------------ writing
    def _put(self, name: str, text: str) -> None:
        """A small file, whole or not there: written beside its place and renamed."""
        place, fs = _fs(self.spark, f"{self.path}/{name}")
        fs.mkdirs(place.getParent())
        half = place.suffix(".half")
        out = fs.create(half, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.rename(half, place)

    def _laid(self, rows: DataFrame, buckets: int) -> DataFrame:
        """rows as they are written. By the keys, not by the bucket: Spark deals rows by the same hash, so no bucket is in two tasks."""
        of = rows.withColumns({"of": F.lit(buckets), "bucket": F.pmod(F.hash(*self.keys), F.lit(buckets))})
        return of.repartition(buckets, *self.keys).sortWithinPartitions("bucket", *self.keys)

    def _write(self, rows: DataFrame, buckets: int, target: str) -> None:
        with _dealt(rows.sparkSession, buckets):
            self._laid(rows, buckets).write.mode("overwrite").partitionBy("of", "bucket").parquet(target)

    def add(self, batch: DataFrame, number: int, size: int | None = None) -> None:
        """Adds a batch under its number: its own rows, merged with each other only. A number that comes again replaces itself,
        or nothing if a base covers it. Past ``compact_after`` batches, they are compacted. ``size`` is the number of the batch's
        rows, or of more, where the caller knows it; else they are counted."""
        now = self.manifest()
        if number <= now["covers"]:
            return
        rows = self.merge(batch)
        if "schema" not in self._names(""):
            self._put("schema", rows.schema.json())
        size = batch.count() if size is None else size
        self._write(rows, max(now["buckets"], -(-size // self.bucket_rows)), f"{self.path}/deltas/batch={number}")
        if len(self.pending()) > self.compact_after:
            self.compact()

    def compact(self) -> None:
        """Folds base and deltas into a new base. It counts from the moment its manifest is there, which is put in place by a rename."""
        now, folders, batches = self.manifest(), self._folders(), self.pending()
        if not batches:
            return
        size = 0
        for f in folders:
            place, fs = _fs(self.spark, f)
            size += fs.getContentSummary(place).getLength()
        then = {"version": now["version"] + 1, "covers": batches[-1], "buckets": max(1, -(-size // self.bucket_bytes), -(-self._rows().count() // self.bucket_rows))}
        self._write(self.merge(self._rows().drop("of", "bucket")), then["buckets"], f"{self.path}/base/v={then['version']}")
        self._put(f"manifest/{then['version']}", json.dumps(then))

    def vacuum(self) -> None:
        """Removes bases and deltas that the newest manifest does not name; readers of older ones must be done."""
        now = self.manifest()
        old = [f"base/{n}" for n in self._names("base") if n != f"v={now['version']}"]
        old += [f"deltas/{n}" for n in self._names("deltas") if int(n.removeprefix("batch=")) <= now["covers"]]
        for name in old:
            place, fs = _fs(self.spark, f"{self.path}/{name}")
            fs.delete(place, True)

    # ------------------------------------------------------------ reading
    def read(self) -> DataFrame:
        return self.merge(self._there())

    def _there(self) -> DataFrame:
        rows = self._rows()
        if rows is None:
            raise ValueError(f"nothing has been added to {self.path}")
        return rows.drop("of", "bucket")

    def dealt(self, by: list[str]) -> DataFrame:
        """The rows of base and deltas, not merged with each other; those of equal ``by``, some or all of the keys, lie in one
        partition, of a fourth of ``bucket_rows`` or so: what reads them may sort them several times at once."""
        rows = self._there()
        return rows.repartition(max(self.buckets, -(-4 * rows.count() // self.bucket_rows)), *by)

    def lookup(self, **key) -> DataFrame:
        """The row of one key: one bucket of the base and of each delta is read."""
        rows = self._rows()
        types = {f.name: f.dataType for f in rows.schema}
        values: list[Column] = [F.lit(key[k]).cast(types[k]) for k in self.keys]
        own = F.col("bucket") == F.pmod(F.hash(*values), F.col("of"))
        for k, v in zip(self.keys, values):
            own = own & F.col(k).eqNullSafe(v)
        return self.merge(rows.where(own).drop("of", "bucket"))

    def written(self) -> DataFrame:
        """(batch, rows) that each batch since the last compaction wrote."""
        folders = f"{self.path}/deltas"
        rows = self.spark.read.schema("batch bigint").option("basePath", folders).parquet(*(f"{folders}/batch={n}" for n in self.pending()))
        return rows.groupBy("batch").agg(F.count("*").alias("rows"))


def merge_stream(stream: DataFrame, table: MergedTable, checkpoint: str, mode: str = "append", prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Drains a stream into a merged table, a batch a delta; ``prepare`` makes a batch's rows of what the stream gives."""

    def write(batch: DataFrame, number: int) -> None:
        rows = staged(batch)  # what is stateful or costly before is worked out once
        if not rows.isEmpty():
            table.add(prepare(rows) if prepare else rows, number)

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
