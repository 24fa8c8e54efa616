"""Live windows: sales joined to the promotions that run while they are made, under two watermarks, and what windows count of them."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import money_sum


def exposed(sales: DataFrame, promos: DataFrame, keys: list[str], ts: str, starts: str, lasts: str, sales_delay: str, promo_delay: str) -> DataFrame:
    """The sales stream with the promotions stream's columns (null where none runs): an outer interval join under two watermarks.

    A promotion of the sale's keys runs from ``starts`` for ``lasts``; there should be one at most at any time, as each that
    runs gives the sale a row. A sale waits in the state until both watermarks have passed it and comes out once, with its
    promotion or without; a promotion is kept while a sale in time may still meet it. Sales with a null key meet none.
    """
    own = {c: f"_p_{c}" for c in promos.columns}
    p = promos.select(*(F.col(c).alias(n) for c, n in own.items())).withWatermark(own[starts], promo_delay)
    begin = F.col(own[starts])
    on = (F.col(ts) >= begin) & (F.col(ts) < begin + F.expr(f"INTERVAL {lasts}"))
    for k in keys:
        on = (F.col(k) == F.col(own[k])) & on
    taken = [c for c in promos.columns if c not in (*keys, starts)]
    joined = sales.withWatermark(ts, sales_delay).join(p, on, "leftOuter")
    return joined.select(*sales.columns, F.col(own[keys[0]]).isNotNull().alias("promoted"), *(F.col(own[c]).alias(c) for c in taken))


def exposure(promoted: str = "promoted", display: str = "on_display", mailer: str = "in_mailer") -> Column:
    shown, mailed = F.col(display), F.col(mailer)
    return F.when(shown & mailed, "both").when(shown, "display").when(mailed, "mailer").when(F.col(promoted), "listed").otherwise("none")


def _windows(rows: DataFrame, ts: str, window: str, keys: list[str], totals: list[Column]) -> DataFrame:
    out = rows.groupBy(F.window(ts, window).alias("w"), *keys).agg(*totals)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(c for c in out.columns if c != "w"))


def promo_windows(rows: DataFrame, ts: str, window: str = "7 days") -> DataFrame:
    """Exposed sales -> totals of each window, product and exposure; a window comes out once, when the watermark closes it."""
    return _windows(rows.withColumn("exposure", exposure()), ts, window, ["product_id", "exposure"], [F.count("*").alias("lines"), F.sum("quantity_units").alias("units"), money_sum("sales_amt").alias("sales_amt")])


def store_health(rows: DataFrame, ts: str, window: str = "1 day") -> DataFrame:
    """Exposed sales -> totals of each window and store, with the lines sold under a promotion."""
    return _windows(rows, ts, window, ["store_id"], [F.count("*").alias("lines"), F.count_if("promoted").alias("promoted_lines"), F.sum("quantity_units").alias("units"), money_sum("sales_amt").alias("sales_amt")])


def with_part(rows: DataFrame, arrival: str, parts: int, span: DataFrame | None = None) -> DataFrame:
    """rows with ``part``, 0 to parts - 1: equal spans of arrival time, from the first arrival in ``span`` (else in rows) to the last."""
    at = F.unix_micros(F.col(arrival).cast("timestamp"))
    ends = (rows if span is None else span).agg(F.min(at).alias("_low"), F.max(at).alias("_high"))
    spans = F.floor((at - F.col("_low")) * parts / (F.col("_high") - F.col("_low") + 1))
    part = F.least(F.greatest(spans, F.lit(0)), F.lit(parts - 1)).cast("int")
    return rows.crossJoin(F.broadcast(ends)).withColumn("part", part).drop("_low", "_high")


@contextmanager
def state_by_cores(spark: SparkSession):
    """Streams first started in here deal their state over as many partitions as there are cores, or fewer if the session says so.

    State is kept in files for each partition and batch, and its number is fixed by a stream's first run; the setting is put back.
    """
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


#: Rows that a state partition should hold at most; some 400 bytes each in the executor's memory, for a join of narrow rows.
STATE_ROWS = 1_000_000


def parts_for(spark: SparkSession, rows: int, at_least: int, state_rows: int = STATE_ROWS) -> int:
    """How many parts of even size rows that wait in the state should land in: a part's rows are in the state together, so that bounds it."""
    held = state_rows * min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(at_least, -(-rows // held))


#: A frame with ``part``, or what makes one of the sources that were written before it.
Source = DataFrame | Callable[[dict[str, DataFrame]], DataFrame]


class _Landing:
    """Sources written once, a folder a part, and their landing folders; a part lands as its folder is put there."""

    def __init__(self, spark: SparkSession, sources: dict[str, Source], folder: str) -> None:
        self.spark, self.folder, self.schemas = spark, folder, {}
        written: dict[str, DataFrame] = {}
        for name, source in sources.items():
            rows = source if isinstance(source, DataFrame) else source(written)
            rows.write.partitionBy("part").parquet(f"{folder}/staged/{name}")
            written[name] = spark.read.schema(rows.schema).parquet(f"{folder}/staged/{name}")
            self.schemas[name] = rows.drop("part").schema
            path, fs = self._path(f"landing/{name}")
            fs.mkdirs(path)

    def _path(self, rest: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{rest}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def land(self, part: int) -> None:
        for name in self.schemas:
            (path, fs), (to, _) = self._path(f"staged/{name}/part={part}"), self._path(f"landing/{name}/{part}")
            if fs.exists(path) and not fs.rename(path, to):
                raise OSError(f"{path} did not land")

    def streams(self) -> dict[str, DataFrame]:
        read = lambda schema: self.spark.readStream.schema(schema).option("recursiveFileLookup", "true")
        return {name: read(schema).parquet(f"{self.folder}/landing/{name}") for name, schema in self.schemas.items()}


def replay(sources: dict[str, DataFrame], parts: int, folder: str, run: Callable[[dict[str, DataFrame], int], None]) -> None:
    """Lands each source (with ``part``) part by part in a folder of its own, and lets ``run`` drain the streams after each part.

    A part is as many files as the tasks that write it; it is put in place whole, not copied.
    """
    spark = next(iter(sources.values())).sparkSession
    landing = _Landing(spark, sources, folder)
    with state_by_cores(spark):
        for part in range(parts):
            landing.land(part)
            run(landing.streams(), part)


def follow(spark: SparkSession, sources: dict[str, Source], parts: int, folder: str, start: Callable[[dict[str, DataFrame]], StreamingQuery]) -> None:
    """As ``replay``, but with one query that ``start`` starts after the first part and that goes on until it has seen all.

    A query that starts again loads its state from all that was ever put there or taken away, so a query for each part costs ever
    more. As this one runs while parts land, it may see a part of one source before that of another: each source's parts should
    be in order within its watermark's delay, as rows late by the watermark of all sources are dropped.
    """
    landing = _Landing(spark, sources, folder)
    landing.land(0)
    with state_by_cores(spark):
        query = start(landing.streams())
    try:
        query.processAllAvailable()
        for part in range(1, parts):
            landing.land(part)
            query.processAllAvailable()
    finally:
        query.stop()
