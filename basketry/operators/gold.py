"""The resolved fact and the aggregates over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import exposure_label, money_sum, ratio
from .rank import staged
from .scd2 import as_of_join


def promo_flags(promo: DataFrame, keys: list[str], display: str = "display", mailer: str = "mailer", shown: str = "R", mailed: str = "F") -> DataFrame:
    """One row for each key: whether any row of it was displayed, or mailed."""
    return promo.groupBy(*keys).agg(F.bool_or(F.col(display) == shown).alias("on_display"), F.bool_or(F.col(mailer) == mailed).alias("in_mailer"))


def build_fact(lines: DataFrame, products: DataFrame, households: DataFrame | None, flags: DataFrame, low: int, high: int) -> DataFrame:
    """Lines with the product and household version in force and their promotion exposure; no line is lost or multiplied.

    The joins that add least come first, so that the next ones shuffle narrow lines. Without ``households`` there is no segment.
    """
    out = lines.join(flags, ["product_id", "store_id", "week_no"], "left")
    if households is not None:
        out = as_of_join(out, households, ["household_key"], "transaction_ts", "left", ["segment"])
    out = as_of_join(out, products, ["product_id"], "transaction_ts", "left", ["department", "brand_tier"])
    return out.withColumn("promo_exposure", exposure_label("week_no", "on_display", "in_mailer", low, high)).drop("on_display", "in_mailer")


def dim_store(lines: DataFrame, promo: DataFrame) -> DataFrame:
    """One row for each store: its activity, volume decile (ties by id) and whether the promotion table knows it."""
    own = lines.where("store_id is not null").groupBy("store_id").agg(
        F.count("*").alias("lines"), F.countDistinct("household_key").alias("households"), F.countDistinct("product_id").alias("products"),
        F.countDistinct("basket_id").alias("baskets"), F.countDistinct("week_no").alias("weeks"), F.min("week_no").alias("first_week"), F.max("week_no").alias("last_week"),
    )
    weeks = promo.groupBy("store_id").agg(F.countDistinct("week_no").alias("promo_weeks"))
    out = own.withColumn("volume_decile", F.ntile(10).over(Window.orderBy("lines", "store_id"))).join(weeks, "store_id", "left")
    return out.withColumns({"has_promo_data": F.col("promo_weeks").isNotNull(), "promo_weeks": F.coalesce("promo_weeks", F.lit(0))})


def rfm(fact: DataFrame) -> DataFrame:
    """One row for each household: recency in days before the fact's last day, frequency, spend, breadth and shares.

    Households are staged once, and the last day is the largest of theirs, so the fact is worked out once.
    """
    out = fact.groupBy("household_key").agg(
        F.max(F.to_date("transaction_ts")).alias("last_seen"), F.min(F.to_date("transaction_ts")).alias("first_seen"), F.countDistinct("basket_id").alias("baskets"),
        money_sum("sales_amt").alias("spend"), F.countDistinct("department").alias("departments"), F.count("*").alias("lines"),
        F.count(F.when(F.col("coupon_disc_amt") < 0, 1)).alias("coupon_lines"), F.count(F.when(F.col("promo_exposure").isin("both", "display", "mailer"), 1)).alias("promo_lines"),
    )
    out = staged(out)
    out = out.crossJoin(F.broadcast(out.agg(F.max("last_seen").alias("_last"))))
    return out.select(
        "household_key", F.datediff("_last", "last_seen").alias("recency_days"), "baskets", "spend", ratio("spend", "baskets").alias("avg_basket"), "departments",
        ratio("coupon_lines", "lines").alias("coupon_share"), ratio("promo_lines", "lines").alias("promo_share"), "first_seen", "last_seen",
    )


def promo_performance(fact: DataFrame) -> DataFrame:
    """Totals of each week, product, department and exposure.

    Groups are small and many, so lines are dealt by group once and a value's first line in its group is marked there; distinct
    counts in one aggregate would send each line on four times.
    """
    keys, counted = ["week_no", "product_id", "department", "promo_exposure"], {"baskets": "basket_id", "households": "household_key", "stores": "store_id"}
    dealt = fact.select(*keys, *counted.values(), "sales_amt", "quantity_units").repartition(*keys)
    marks = {f"_{n}": (F.row_number().over(Window.partitionBy(*keys, c).orderBy(c)) == 1) & F.col(c).isNotNull() for n, c in counted.items()}
    return dealt.withColumns(marks).groupBy(*keys).agg(money_sum("sales_amt").alias("sales_amt"), F.sum("quantity_units").alias("units"), *(F.count_if(f"_{n}").alias(n) for n in counted))


def store_daily(fact: DataFrame, stores: DataFrame) -> DataFrame:
    """Totals of each day and store, with the store's decile and promotion flag."""
    day = fact.where("store_id is not null").groupBy(F.to_date("transaction_ts").alias("day"), "store_id").agg(
        F.count("*").alias("lines"), F.countDistinct("basket_id").alias("baskets"), money_sum("sales_amt").alias("sales_amt"), F.sum("quantity_units").alias("units")
    )
    return day.join(stores.select("store_id", "volume_decile", "has_promo_data"), "store_id", "left")


def store_anomalies(daily: DataFrame, days: int = 28, limit: float = 3.0) -> DataFrame:
    """daily with the store's own mean and deviation of the rows before, z, and is_anomaly (null z is none)."""
    own = Window.partitionBy("store_id").orderBy("day").rowsBetween(-days, -1)
    x = F.col("sales_amt")
    out = daily.withColumns({"_m": F.avg(x).over(own), "_s": F.stddev_samp(x).over(own)})
    out = out.withColumn("z", F.round(F.try_divide(x - F.col("_m"), F.nullif(F.col("_s"), F.lit(0.0))), 3))
    return out.withColumn("is_anomaly", F.coalesce(F.abs("z") > limit, F.lit(False))).drop("_m", "_s")
