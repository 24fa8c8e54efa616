"""A metric layer: each measure is defined once, and worked out at whatever grain is asked for."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import money_sum, ratio
from ..operators.rank import staged


@dataclass(frozen=True)
class Measure:
    """Either an aggregate over the view's rows, or a formula over measures of the same view by name."""

    name: str
    aggregate: Callable[[], Column] | None = None
    derived: Callable[[dict[str, Column]], Column] | None = None
    needs: tuple[str, ...] = ()
    unit: str = ""
    distinct: str | None = None  # the column whose distinct values ``aggregate`` counts, if it is such a count


def distinct_measure(name: str, column: str, unit: str = "count") -> Measure:
    """The number of distinct values of a column."""
    return Measure(name, lambda: F.countDistinct(column), unit=unit, distinct=column)


@dataclass(frozen=True)
class View:
    name: str
    dimensions: dict[str, Callable[[], Column]]
    measures: dict[str, Measure] = field(default_factory=dict)


def view(name: str, dimensions: Sequence[str], measures: Sequence[Measure]) -> View:
    return View(name, {d: (lambda d=d: F.col(d)) for d in dimensions}, {m.name: m for m in measures})


def check_registry(views: Sequence[View]) -> None:
    """Every measure defined once over all views, either way but not both, and derived from base measures of its own view."""
    seen: set[str] = set()
    for v in views:
        for name, m in v.measures.items():
            if name in seen:
                raise ValueError(f"{name} is defined twice")
            seen.add(name)
            if (m.aggregate is None) == (m.derived is None):
                raise ValueError(f"{name} must be an aggregate or derived")
            for n in m.needs:
                if n not in v.measures or v.measures[n].aggregate is None:
                    raise ValueError(f"{name} needs {n}, which is no base measure of {v.name}")
            if name in v.dimensions:
                raise ValueError(f"{name} is a dimension too")


def _distinct_rollup(rows: DataFrame, dims: list[str], column: str, name: str) -> DataFrame:
    """(dims, _level, name): how many values of the column each group of a rollup holds, from one shuffle of distinct pairs.

    The combinations that hold a value are put in order. One that differs from that before it in its first n dimensions is the
    value's first in its group by n dimensions, and counts there; so counts of combinations add up to those of every level.
    """
    pairs = rows.where(F.col(column).isNotNull()).select(column, *dims).repartition(column).distinct()
    own = Window.partitionBy(column).orderBy(*dims)
    shared = F.lit(len(dims))
    for n, d in reversed(list(enumerate(dims))):
        shared = F.when(F.lag(d).over(own).eqNullSafe(F.col(d)), shared).otherwise(n)
    shared = F.when(F.row_number().over(own) == 1, -1).otherwise(shared)
    cells = pairs.withColumn("_shared", shared).groupBy(*dims).agg(*(F.count_if(F.col("_shared") < n).alias(f"_n{n}") for n in range(len(dims) + 1)))
    levels = cells.rollup(*dims).agg(F.grouping_id().alias("_level"), *(F.sum(f"_n{n}").alias(f"_n{n}") for n in range(len(dims) + 1)))
    count = F.coalesce(*(F.when(F.col("_level") == (1 << len(dims) - n) - 1, F.col(f"_n{n}")) for n in range(len(dims) + 1)))
    return levels.select(*dims, "_level", count.alias(name))


def _rollup(rows: DataFrame, dims: list[str], v: View, base: list[str]) -> DataFrame:
    """The base measures of a rollup. With distinct counts rows are written once, as Spark would send on each for every level and count."""
    counts = {b: v.measures[b].distinct for b in base if v.measures[b].distinct}
    rows = staged(rows) if counts else rows
    sums = [v.measures[b].aggregate().alias(f"_m_{b}") for b in base if b not in counts]
    out = rows.rollup(*dims).agg(F.grouping_id().alias("_level"), *sums)
    for b, column in counts.items():
        found = _distinct_rollup(rows, dims, column, f"_m_{b}").select(*(F.col(d).alias(f"_r{d}") for d in dims), F.col("_level").alias("_l"), f"_m_{b}")
        on = reduce(lambda x, y: x & y, (F.col(d).eqNullSafe(F.col(f"_r{d}")) for d in dims), F.col("_level") == F.col("_l"))
        out = out.join(found, on, "left").drop("_l", *(f"_r{d}" for d in dims)).fillna(0, f"_m_{b}")
    return out


def metric_query(df: DataFrame, v: View, measures: Sequence[str], dims: Sequence[str] = (), where: str | None = None, rollup: bool = False) -> DataFrame:
    """The measures by the dimensions: base measures are aggregated at this grain, then ratios are taken of them."""
    check_registry([v])
    unknown = [m for m in measures if m not in v.measures] + [d for d in dims if d not in v.dimensions]
    if unknown:
        raise KeyError(f"{v.name} has no {', '.join(unknown)}")
    rows = df.where(where) if where else df
    base = list(dict.fromkeys(n for m in measures for n in ((m,) if v.measures[m].aggregate else v.measures[m].needs)))
    keyed = rows.withColumns({f"_d_{d}": v.dimensions[d]() for d in dims})
    named = [f"_d_{d}" for d in dims]
    out = _rollup(keyed, named, v, base) if rollup and dims else keyed.groupBy(*named).agg(*(v.measures[b].aggregate().alias(f"_m_{b}") for b in base))
    have = {b: F.col(f"_m_{b}") for b in base}
    return out.select(*(F.col(f"_d_{d}").alias(d) for d in dims), *((have[m] if m in have else v.measures[m].derived(have)).alias(m) for m in measures))


COMMERCIAL = view(
    "commercial",
    ["promo_exposure", "department", "week_no", "store_id"],
    [
        Measure("net_sales_amt", lambda: money_sum("sales_amt"), unit="currency"),
        Measure("units_sold", lambda: F.sum(F.when(F.coalesce(F.col("department"), F.lit("")) != "MOVED", F.col("quantity_units")).otherwise(0)), unit="units"),
        distinct_measure("baskets", "basket_id"),
        distinct_measure("households", "household_key"),
        Measure("retail_discount_amt", lambda: -money_sum("retail_disc_amt"), unit="currency"),
        Measure("coupon_discount_amt", lambda: -money_sum("coupon_disc_amt"), unit="currency"),
        Measure("avg_basket_amt", derived=lambda m: ratio(m["net_sales_amt"], m["baskets"]), needs=("net_sales_amt", "baskets"), unit="currency"),
        Measure("discount_rate", derived=lambda m: ratio(m["retail_discount_amt"], m["net_sales_amt"] + m["retail_discount_amt"]), needs=("retail_discount_amt", "net_sales_amt"), unit="share"),
    ],
)

HOUSEHOLD = view(
    "household_lifecycle",
    ["segment"],
    [
        Measure("active_households", lambda: F.countDistinct(F.when(F.col("recency_days") <= 365, F.col("household_key"))), unit="count"),
        Measure("total_households", lambda: F.countDistinct("household_key"), unit="count"),
        Measure("household_spend", lambda: money_sum("spend"), unit="currency"),
        Measure("active_rate", derived=lambda m: ratio(m["active_households"], m["total_households"]), needs=("active_households", "total_households"), unit="share"),
    ],
)
