"""Lapse features of households, their label, and the check that nothing after the split leaks into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import money_sum, portable_hash, ratio
from ..operators.audits import two_way_difference
from ..operators.rank import running_sums


def lapse_features(lines: DataFrame, split_day: str) -> DataFrame:
    """One row for each household seen before ``split_day``: its behaviour up to then, and lapsed = not seen from then on."""
    split = F.lit(split_day).cast("date")
    lines = lines.withColumn("day", F.to_date("transaction_ts"))
    seen = lines.where(F.col("day") < split)
    basket = seen.groupBy("household_key", "basket_id").agg(money_sum("sales_amt").alias("amt"), F.count("*").alias("lines"), F.min("day").alias("day"), F.min("store_id").alias("store"))
    own = basket.groupBy("household_key").agg(
        F.count("*").alias("frequency_baskets"), money_sum("amt").alias("monetary_amt"), F.round(F.stddev_samp("amt"), 3).alias("std_basket_amt"),
        F.sum("lines").alias("_lines"), F.max("day").alias("_last"), F.min("day").alias("_first"), F.countDistinct("store").alias("distinct_stores"),
    )
    line = seen.groupBy("household_key").agg(
        F.countDistinct("product_id").alias("distinct_products"), F.sum("quantity_units").alias("total_units"), money_sum("retail_disc_amt").alias("retail_disc_amt"),
        money_sum("coupon_disc_amt").alias("coupon_disc_amt"), F.coalesce(money_sum(F.when(F.col("day") > F.date_sub(split, 56), F.col("sales_amt"))), F.lit(0.0)).alias("recent_amt"),
    )
    back = lines.where(F.col("day") >= split).select("household_key").distinct().withColumn("_back", F.lit(1))
    out = own.join(line, "household_key").join(back, "household_key", "left")
    tenure = F.datediff("_last", "_first")
    out = out.withColumns({"recency_days": F.datediff(split, F.col("_last")), "tenure_days": tenure, "avg_basket_amt": ratio("monetary_amt", "frequency_baskets"), "avg_basket_lines": ratio("_lines", "frequency_baskets")})
    cadence = F.when(F.col("frequency_baskets") > 1, F.col("tenure_days") / (F.col("frequency_baskets") - 1))
    out = out.withColumns(
        {
            "avg_days_between": cadence,
            "discount_share": ratio(F.abs("retail_disc_amt"), "monetary_amt"),
            "coupon_share": ratio(F.abs("coupon_disc_amt"), "monetary_amt"),
            "recent_vs_typical": ratio("recent_amt", F.col("monetary_amt") / F.greatest(F.col("tenure_days") / 7, F.lit(1.0)) * 8),
            "lapsed": F.col("_back").isNull().cast("int"),
        }
    )
    return out.withColumn("recency_over_cadence", ratio("recency_days", "avg_days_between")).drop("_lines", "_last", "_first", "_back")


def leakage_diff(lines: DataFrame, split_day: str) -> DataFrame:
    """Feature rows that change when all lines from the split on are taken away; the label is left out. Must be empty."""
    before = lines.where(F.to_date("transaction_ts") < F.lit(split_day).cast("date"))
    return two_way_difference(lapse_features(lines, split_day).drop("lapsed"), lapse_features(before, split_day).drop("lapsed"))


def lapse_sweep(lines: DataFrame, split_days: list[str]) -> DataFrame:
    """(split_day, households, lapsed, lapse_rate) for several splits, from each household's days in one pass."""
    days = lines.select("household_key", F.to_date("transaction_ts").alias("day")).groupBy("household_key").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    each = days.select("*", F.explode(F.array(*(F.lit(d).cast("date") for d in split_days))).alias("split_day"))
    out = each.where("first < split_day").groupBy("split_day").agg(F.count("*").alias("households"), F.count(F.when(F.col("last") < F.col("split_day"), 1)).alias("lapsed"))
    return out.withColumn("lapse_rate", ratio("lapsed", "households"))


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.75, seed: int = 7) -> DataFrame:
    """df with is_train: in each label the ``share`` of rows (rounded up) whose key has the smallest hash.

    Ranks come from one order over label and hash that is dealt by range, so no task orders a label's rows.
    """
    hashed = df.withColumns({"_h": portable_hash(key, seed=seed), "_one": F.lit(1).cast("bigint")})
    ranked = running_sums(hashed, [label, "_h", key], ["_one"])
    per = ranked.groupBy(label).agg(F.min("before__one").alias("_first"), F.count("*").alias("_n"))
    placed = ranked.join(F.broadcast(per), ranked[label].eqNullSafe(per[label])).drop(per[label])
    return placed.withColumn("is_train", F.col("before__one") - F.col("_first") < F.ceil(share * F.col("_n"))).select(*df.columns, "is_train")


def breadth_entropy(lines: DataFrame, category: str = "department") -> DataFrame:
    """(household_key, entropy) of a household's spend over categories."""
    spend = lines.groupBy("household_key", category).agg(F.sum(F.col("sales_amt").cast("decimal(18,2)")).cast("double").alias("s"))
    total = Window.partitionBy("household_key")
    p = spend.withColumn("p", ratio("s", F.sum("s").over(total))).where("p > 0")
    return p.groupBy("household_key").agg(F.round(-F.sum(F.col("p") * F.log("p")), 4).alias("entropy"))


def population_stability(base: DataFrame, now: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """One row: the population stability index of a column over the base's quantile bins.

    A bin's edge is the value at rank ceil(i n / bins) of the base's n values; values repeat in one row while they are ranked, and
    ranks are dealt by range, so no task holds all values.
    """
    known = lambda f: f.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count("*").alias("n"))
    ranked = running_sums(known(base), ["x"], ["n"])
    total = ranked.agg(F.sum("n").alias("t"))
    cut = ranked.crossJoin(F.broadcast(total)).select("x", "n", "before_n", F.explode(F.array(*(F.ceil(i * F.col("t") / bins) for i in range(1, bins)))).alias("at"))
    edges = cut.where("at > before_n and at <= before_n + n").agg(F.sort_array(F.collect_list("x")).alias("e"))  # bins - 1 values
    bin_of = F.size(F.filter("e", lambda e: e < F.col("x")))
    share = lambda f, n: f.crossJoin(F.broadcast(edges)).groupBy(bin_of.alias("bin")).agg(F.sum("n").alias(n))
    both = share(ranked, "nb").join(share(known(now), "nn"), "bin", "full").fillna(0, ["nb", "nn"])
    totals = both.agg(F.sum("nb").alias("tb"), F.sum("nn").alias("tn"))
    rated = both.crossJoin(F.broadcast(totals)).select(((F.col("nb") + 0.5) / (F.col("tb") + 1)).alias("b"), ((F.col("nn") + 0.5) / (F.col("tn") + 1)).alias("n"))
    return rated.agg(F.round(F.sum((F.col("n") - F.col("b")) * F.log(F.col("n") / F.col("b"))), 4).alias("psi"))


def only_real(df: DataFrame, synthetic: str) -> DataFrame:
    """df without rows that are flagged as synthetic; a row whose flag is null counts as real."""
    return df.where(~F.coalesce(F.col(synthetic), F.lit(False)))
