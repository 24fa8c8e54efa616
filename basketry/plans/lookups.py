"""Parameterised lookups as SQL table functions over registered views; arguments are bound, never pasted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# name -> (arguments, result columns, query over the views named in it)
FUNCTIONS = {
    "promo_lookup": ("product BIGINT, week INT", "promo_exposure STRING, sales_amt DOUBLE, baskets BIGINT, stores BIGINT", "SELECT promo_exposure, sales_amt, baskets, stores FROM promo_performance WHERE product_id = product AND week_no = week"),
    "store_day_lookup": ("store BIGINT, on_day DATE", "lines BIGINT, baskets BIGINT, sales_amt DOUBLE, units BIGINT, volume_decile INT", "SELECT lines, baskets, sales_amt, units, volume_decile FROM store_daily WHERE store_id = store AND day = on_day"),
    "household_lookup": ("household BIGINT", "recency_days INT, baskets BIGINT, spend DOUBLE, avg_basket DOUBLE, coupon_share DOUBLE, promo_share DOUBLE", "SELECT recency_days, baskets, spend, avg_basket, coupon_share, promo_share FROM household_rfm WHERE household_key = household"),
}


def register(spark: SparkSession, frames: dict[str, DataFrame]) -> None:
    """Registers the views and the functions whose views are there."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    for name, (arguments, columns, body) in FUNCTIONS.items():
        if any(f"FROM {v} " in body for v in frames):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({columns}) RETURN {body}")


def lookup(spark: SparkSession, name: str, **arguments) -> DataFrame:
    """The rows of a lookup; none where nothing matches, never zeros. Wrong argument names or types raise."""
    wanted = {a.split()[0]: a.split()[1] for a in FUNCTIONS[name][0].split(", ")}
    if set(arguments) != set(wanted):
        raise TypeError(f"{name} takes {', '.join(wanted)}")
    for key, kind in wanted.items():
        if kind in ("BIGINT", "INT") and (not isinstance(arguments[key], int) or isinstance(arguments[key], bool)):
            raise TypeError(f"{key} must be a whole number")
    bound = ", ".join(f"CAST(:{a} AS {k})" for a, k in wanted.items())
    return spark.sql(f"SELECT * FROM {name}({bound})", args=arguments)
