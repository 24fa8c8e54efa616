"""Bootstrap of whole groups, and checks that a sample is like its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import portable_hash
from .rank import running_sums
from .skew import skew_curve


def bootstrap_groups(df: DataFrame, group: str, draws: int, seed: int, weight: str | None = None, exponent: float = 1.0) -> DataFrame:
    """``draws`` groups drawn with replacement, each with all its rows, and ``draw_id``.

    Groups stand in order on a line, each as long as its weight to the exponent (the largest weight of its rows, 1 without one, in
    whole units, 1 at least). A draw is a point on the line from a hash of its number and the seed, so the same seed draws the same
    groups. Draws meet groups by blocks of the line of the mean length of a group: a group has a row for each block that it reaches
    into, twice the number of groups in all whatever the weights are.
    """
    spark = df.sparkSession
    size = F.greatest(F.lit(1), F.round(F.pow(F.max(weight).cast("double"), F.lit(exponent))).cast("bigint")) if weight else F.lit(1).cast("bigint")
    groups = df.groupBy(group).agg(size.alias("_size")).where(F.col(group).isNotNull())
    line = running_sums(groups, [group], ["_size"])
    whole = F.broadcast(line.agg(F.sum("_size").alias("_whole"), F.greatest(F.lit(1), F.floor(F.avg("_size"))).cast("bigint").alias("_block")))
    points = spark.range(draws).crossJoin(whole).where("_whole > 0").select(F.col("id").alias("draw_id"), F.pmod(portable_hash("id", seed=seed), F.col("_whole")).alias("_at"), "_block")
    points = points.withColumn("_b", F.floor(F.col("_at") / F.col("_block")))
    ends = F.col("before__size") + F.col("_size")
    reach = F.sequence(F.floor(F.col("before__size") / F.col("_block")), F.floor((ends - 1) / F.col("_block")))
    spread = line.crossJoin(whole).select(group, F.col("before__size").alias("_from"), ends.alias("_to"), F.explode(reach).alias("_b"))
    drawn = points.join(spread, "_b").where("_at >= _from and _at < _to").select("draw_id", group)
    return drawn.join(df, group)


def total_variation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: half the sum of differences of the shares of each key."""
    share = lambda f, n: f.groupBy(key).agg(F.count("*").alias(n))
    both = share(a, "na").join(share(b, "nb"), key, "full").fillna(0, ["na", "nb"])
    totals = both.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    return both.crossJoin(F.broadcast(totals)).agg((F.sum(F.abs(F.col("na") / F.col("ta") - F.col("nb") / F.col("tb")).cast("decimal(20,12)")) / 2).cast("double").alias("distance"))


def broken_groups(sample: DataFrame, source: DataFrame, group: str, draw: str, item: str, amount: str) -> DataFrame:
    """Draws whose lines, items or amount differ from those of their group in the source."""
    facts = [F.count("*").alias("n"), F.sum(F.xxhash64(item).cast("decimal(38,0)")).alias("h"), F.sum(F.col(amount).cast("decimal(18,2)")).alias("a")]
    own = sample.groupBy(draw, group).agg(*facts)
    return own.join(source.groupBy(group).agg(*facts), [group, "n", "h", "a"], "left_anti")


def fidelity(sample: DataFrame, source: DataFrame, halves: Column, key: str, noise_factor: float = 1.5) -> DataFrame:
    """One row: how far the sample's shares of ``key`` are from the source's, beside the noise floor.

    The floor is the distance of the source's two ``halves`` (a boolean); the sample passes within ``noise_factor`` of it.
    ``top_decile_share`` is what the largest tenth of the keys holds, in each frame.
    """
    far = total_variation(sample, source, key).select(F.col("distance"))
    floor = total_variation(source.where(halves), source.where(~halves), key).select(F.col("distance").alias("noise_floor"))
    top = lambda f, n: skew_curve(f, [key], [0.1]).select(F.col("share_of_rows").alias(n))
    both = far.crossJoin(floor).crossJoin(top(sample, "sample_top_decile_share")).crossJoin(top(source, "source_top_decile_share"))
    return both.withColumns(
        {"within_noise": F.col("distance") <= noise_factor * F.col("noise_floor"), "decile_kept": F.abs(F.col("sample_top_decile_share") - F.col("source_top_decile_share")) <= 0.03}
    )


def observed_rates(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """(rate_name, observed) of each predicate, in one pass."""
    parts = [F.struct(F.lit(k).alias("rate_name"), F.try_divide(F.count(F.when(F.expr(p), 1)).cast("double"), F.count(F.lit(1)).cast("double")).alias("observed")) for k, p in flags.items()]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))
