"""Mergeable sketches: distinct counts by HyperLogLog and quantiles by KLL, stored small and united at any grain later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base-2 logarithm of a distinct sketch's registers: its standard error is 1.04 over their square root, 1.6 %.
LOG_REGISTERS = 12
DISTINCT_ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2)
#: Size parameter of quantile sketches: ranks are right to about 1.65 % at 200, and to 0.4 % at 800, with 99 % certainty.
KLL_K = 800
RANK_ERROR = 0.0042


def distinct_sketches(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, rows, sketch) of the distinct values of a column; some kB a group whatever its rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.hll_sketch_agg(column, LOG_REGISTERS).alias("sketch"))


def rolled_up(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, estimate) from stored sketches alone; with no keys, of all."""
    return sketches.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def within_error(estimate: str, exact: str, sigmas: float = 4.0) -> F.Column:
    """Whether an estimate is as near to the count as so many standard errors."""
    return F.abs(F.col(estimate) - F.col(exact)) <= F.ceil(sigmas * DISTINCT_ERROR * F.col(exact))


def quantile_sketches(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, rows, sketch) of a numeric column, nulls left out; mergeable, so periods and tasks can be sketched apart."""
    rows = df.where(F.col(column).isNotNull())
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(KLL_K)).alias("sketch"))


def sketch_stability(base: DataFrame, now: DataFrame, bins: int = 10) -> DataFrame:
    """(psi): the population stability index of two one-row frames of quantile sketches, without their rows.

    The base's quantiles are the edges; shares are differences of ranks, smoothed as ``features.population_stability`` does.
    """
    at = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    edges = base.select(F.array_distinct(F.kll_sketch_get_quantile_double("sketch", at))).first()[0]  # bins - 1 values; ranks are asked of constants
    both = base.select(F.col("sketch").alias("b"), F.col("rows").alias("nb")).crossJoin(now.select(F.col("sketch").alias("n"), F.col("rows").alias("nn")))
    ranks = lambda s: F.concat(F.array(F.lit(0.0)), F.kll_sketch_get_rank_double(s, F.array(*map(F.lit, edges))), F.array(F.lit(1.0)))
    shares = lambda r, rows: F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda i: ((F.get(r, i) - F.get(r, i - 1)) * F.col(rows) + 0.5) / (F.col(rows) + 1))
    sides = both.select(shares(ranks("b"), "nb").alias("p"), shares(ranks("n"), "nn").alias("q"))
    term = F.zip_with("p", "q", lambda p, q: (q - p) * F.ln(q / p))
    return sides.select(F.aggregate(term, F.lit(0.0), lambda a, x: a + x).alias("psi"))
