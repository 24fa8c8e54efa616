"""Aggregates kept up by signed changes: an insert counts +1, a retraction -1, and what was summed before is never read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming.deltas import MergedTable, summed

#: Units that go into a sum's low half.
_HALF = 10**9


class SumView:
    """Rows, sums and distinct counts of a group, as partial totals that add up when they are read.

    ``sums`` names measures (summed as decimals of 18 digits and ``scale`` places, a null as 0), ``distincts`` columns whose distinct
    values are counted. A table keeps the totals of each combination that a group holds of those values, which are no more than its rows,
    so that a value goes when its last row is retracted. A batch writes what it changes and no more, once; compaction folds batches
    together. Retractions must name rows as they were inserted. Batches go by number, and one that comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sums: list[str], distincts: list[str], scale: int = 4, compact_after: int = 16) -> None:
        self.keys, self.sums, self.distincts, self.scale = keys, sums, distincts, scale
        by = [*keys, *distincts]
        self.held = MergedTable(spark, f"{path}/held", by, summed(by, ["lines", *(f"{half}_{c}" for c in sums for half in ("_high", "_low"))]), compact_after)

    def apply(self, changes: DataFrame, number: int, sign: str = "sign") -> None:
        """Adds a batch of rows with ``sign`` +1 or -1."""
        s, halves = F.col(sign).cast("long"), []
        for c in self.sums:
            # whole units in two halves, each with room for 9e9 rows: Spark adds up longs in compiled code, decimals this wide row by row
            units = (F.coalesce(F.col(c), F.lit(0)).cast(f"decimal(18,{self.scale})") * F.lit(10**self.scale)).cast("long") * s
            halves += [F.call_function("div", units, F.lit(_HALF)).alias(f"_high_{c}"), (units % _HALF).alias(f"_low_{c}")]
        self.held.add(changes.select(*self.held.keys, s.alias("lines"), *halves), number)

    def read(self) -> DataFrame:
        """(keys, lines, sums as doubles, a count for each distinct column): groups that hold rows.

        Several distinct columns are counted where a group lies, by marks on a value's first row, which spares merging the
        combinations before; groups are small and many.
        """
        several, marks = len(self.distincts) > 1, {}
        rows = self.held.dealt(self.keys) if several else self.held.merge(self.held.dealt(self.held.keys))
        for c in self.distincts:
            held = Window.partitionBy(*self.keys, c).orderBy(c)
            times = F.sum("lines").over(held.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            first = (F.row_number().over(held) == 1) & (times > 0) if several else F.col("lines") > 0
            marks[f"_{c}"] = first & F.col(c).isNotNull()
        units = lambda c: F.sum(f"_high_{c}").cast("decimal(20,0)") * _HALF + F.sum(f"_low_{c}")
        sums = [F.concat(units(c).cast("string"), F.lit(f"E-{self.scale}")).cast("double").alias(c) for c in self.sums]  # the nearest double
        return rows.withColumns(marks).groupBy(*self.keys).agg(F.sum("lines").alias("lines"), *sums, *(F.count_if(f"_{c}").alias(c) for c in self.distincts)).where("lines > 0")
