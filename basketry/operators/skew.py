"""Key skew: how it shows, and joins and aggregates that stand it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: AQE splits a join partition that is over this many times the median and over this many bytes.
SKEW_RATIO, SKEW_BYTES = 5.0, 256 << 20


def key_skew(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys, rows, the largest, median and p99 count of a key, and largest over median."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    out = per.agg(F.count("*").alias("keys"), F.sum("n").alias("rows"), F.max("n").alias("max_rows"), F.percentile("n", 0.5).alias("median_rows"), F.percentile("n", 0.99).alias("p99_rows"))
    return out.withColumn("max_over_median", F.col("max_rows") / F.col("median_rows"))


def row_bytes(widths: list[int]) -> int:
    """Estimated bytes of a row: a header word, a word a field, and text of these lengths rounded up to words (0: a number)."""
    return 8 + sum(8 + (w + 7) // 8 * 8 for w in widths)


def partition_skew(df: DataFrame, keys: list[str], sizes: list[int], bytes_per_row: int) -> DataFrame:
    """For each number of shuffle partitions: the largest and median partition, their ratio, and whether AQE would split.

    Keys are counted once; partitions are sums of key counts. ``break_even_bytes`` is the width of a row from which it would.
    """
    per = df.groupBy(F.hash(*keys).alias("_h")).agg(F.count("*").alias("n"))
    dealt = per.select("n", "_h", F.explode(F.array(*map(F.lit, sizes))).alias("partitions"))
    parts = dealt.groupBy("partitions", F.pmod("_h", F.col("partitions")).alias("_p")).agg(F.sum("n").alias("rows"))
    out = parts.groupBy("partitions").agg(F.max("rows").alias("max_rows"), F.percentile("rows", 0.5).alias("median_rows"), F.count("*").alias("filled"))
    over = F.col("max_rows") / F.col("median_rows")
    return out.withColumns({"max_over_median": over, "max_bytes": F.col("max_rows") * bytes_per_row, "break_even_bytes": F.ceil(F.lit(SKEW_BYTES) / F.col("max_rows")), "aqe_splits": (over > SKEW_RATIO) & (F.col("max_rows") * bytes_per_row > SKEW_BYTES)})


def skew_curve(df: DataFrame, keys: list[str], points: list[float]) -> DataFrame:
    """(share_of_keys, keys_taken, share_of_rows): what the largest keys hold, at least one key a point.

    Counts of counts are summed, so the window runs over distinct counts, not over keys.
    """
    per = df.groupBy(*keys).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("k"))
    total = per.agg(F.sum("k").alias("keys"), F.sum(F.col("n") * F.col("k")).alias("rows"))
    from pyspark.sql import Window

    down = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    before = per.withColumns({"_k": F.coalesce(F.sum("k").over(down), F.lit(0)), "_r": F.coalesce(F.sum(F.col("n") * F.col("k")).over(down), F.lit(0))}).crossJoin(F.broadcast(total))
    at = before.select("*", F.explode(F.array(*map(F.lit, points))).alias("share_of_keys"))
    at = at.withColumn("keys_taken", F.greatest(F.lit(1), F.bround(F.col("keys") * F.col("share_of_keys")).cast("bigint")))
    hit = at.where("keys_taken > _k and keys_taken <= _k + k")
    return hit.select("share_of_keys", "keys_taken", ((F.col("_r") + (F.col("keys_taken") - F.col("_k")) * F.col("n")) / F.col("rows")).alias("share_of_rows"))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salt_cols: list[str], salts: int, how: str = "inner", hint: str | None = None) -> DataFrame:
    """Joins with the left's keys dealt over ``salts`` parts by a hash of other columns and the right repeated for each.

    Worth its price only where ``partition_skew`` says that a key is hot and AQE would not split it.
    """
    salt = F.pmod(F.hash(*salt_cols), F.lit(salts))
    spread = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    return left.withColumn("_salt", salt).join(spread.hint(hint) if hint else spread, [*keys, "_salt"], how).drop("_salt")


def hot_keys(df: DataFrame, keys: list[str], share: float = 0.05) -> list[int]:
    """Hashes of the keys that hold more than ``share`` of the rows: at most 1 / share of them, found by a frequent-items sketch.

    The sketch tracks a bounded number of keys in one pass and is exact to a fraction of ``share``; a key near it may count or not,
    which changes how rows are dealt and no result.
    """
    most = max(1, int(1 / share))
    tracked = 1 << max(6, (16 * most - 1).bit_length())
    hashed = df.select(F.xxhash64(*keys).alias("h"))
    found = hashed.agg(F.expr(f"approx_top_k(h, {most}, {tracked})").alias("top"), F.count("*").alias("n")).first()
    return sorted(r["item"] for r in found["top"] or [] if r["count"] > share * found["n"])


def hot_salted_join(left: DataFrame, right: DataFrame, keys: list[str], salt_cols: list[str], salts: int, hot: list[int], how: str = "inner", hint: str | None = None) -> DataFrame:
    """``salted_join`` for the hot keys alone: only their rows are dealt over parts, and only their matches are repeated."""
    is_hot = F.xxhash64(*keys).isin(hot) if hot else F.lit(False)
    spread = right.select("*", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("_salt"))
    dealt = left.withColumn("_salt", F.when(is_hot, F.pmod(F.hash(*salt_cols), F.lit(salts))).otherwise(0))
    return dealt.join(spread.hint(hint) if hint else spread, [*keys, "_salt"], how).drop("_salt")


def hot_salted_agg(df: DataFrame, key: str, distinct: str, amount: str, salts: int, hot: list[int]) -> DataFrame:
    """``salted_agg`` with a salt for the hot keys alone, so that other groups are made in one piece."""
    salt = F.when(F.xxhash64(key).isin(hot) if hot else F.lit(False), F.pmod(F.hash(distinct), F.lit(salts))).otherwise(0)
    first = df.groupBy(key, salt.alias("_salt")).agg(F.count("*").alias("rows"), F.sum(F.col(amount).cast("decimal(18,2)")).alias("amount"), F.countDistinct(distinct).alias("distinct_values"))
    return first.groupBy(key).agg(F.sum("rows").alias("rows"), F.sum("amount").cast("double").alias("amount"), F.sum("distinct_values").alias("distinct_values"))


def preagg_join(left: DataFrame, right: DataFrame, keys: list[str], aggregates: list[Column], how: str = "inner") -> DataFrame:
    """The left is brought to the grain of the join before it is joined."""
    return left.groupBy(*keys).agg(*aggregates).join(right, keys, how)


def small_enough(df: DataFrame, bytes_: int = 64 << 20) -> bool:
    """Whether the planner's own estimate of a frame's size is within a bound for broadcasting."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= bytes_


def broadcast_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", bytes_: int = 64 << 20) -> DataFrame:
    """A broadcast join while the right is within the bound, else the planner's choice."""
    return left.join(F.broadcast(right) if small_enough(right, bytes_) else right, keys, how)


def merge_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return left.join(right.hint("merge"), keys, how)


def salted_agg(df: DataFrame, key: str, distinct: str, amount: str, salts: int = 16) -> DataFrame:
    """(key, rows, amount, distinct count) in two stages; the salt is a hash of the counted column, so the count is exact."""
    first = df.groupBy(key, F.pmod(F.hash(distinct), F.lit(salts)).alias("_salt")).agg(
        F.count("*").alias("rows"), F.sum(F.col(amount).cast("decimal(18,2)")).alias("amount"), F.countDistinct(distinct).alias("distinct_values")
    )
    return first.groupBy(key).agg(F.sum("rows").alias("rows"), F.sum("amount").cast("double").alias("amount"), F.sum("distinct_values").alias("distinct_values"))


def plain_agg(df: DataFrame, key: str, distinct: str, amount: str) -> DataFrame:
    """What ``salted_agg`` gives, in one aggregate: the baseline it is measured against."""
    return df.groupBy(key).agg(F.count("*").alias("rows"), F.sum(F.col(amount).cast("decimal(18,2)")).cast("double").alias("amount"), F.countDistinct(distinct).alias("distinct_values"))


def volume_matched(df: DataFrame, even: str, skewed: str, amount: str) -> DataFrame:
    """(key_kind, groups, rows, max_rows, amount): the same rows and bytes grouped by an even and by a skewed key of as many groups.

    Both see all rows, and the even key is folded onto the number of the skewed key's values, so that only the skew differs.
    """
    n = df.agg(F.countDistinct(skewed).alias("_n"))
    keyed = df.crossJoin(F.broadcast(n)).withColumn("_even", F.pmod(F.col(even), F.col("_n")))

    def one(kind: str, key: str) -> DataFrame:
        per = keyed.groupBy(key).agg(F.count("*").alias("r"), F.sum(F.col(amount).cast("decimal(18,2)")).alias("a"))
        return per.agg(F.count("*").alias("groups"), F.sum("r").alias("rows"), F.max("r").alias("max_rows"), F.sum("a").cast("double").alias("amount")).select(F.lit(kind).alias("key_kind"), "*")

    return one("even", "_even").unionByName(one("skewed", skewed))
