"""Registered queries over layouts, heavy hitters, mergeable sketches and variants."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import layout, rank, sketches, skew
from .plans import features
from .queries import _JOINED, _SKEWED, _by_hot, _landed, _suppliers, flags, query, skewed, sum_of
from .queries_lab import _BY_STORE
from .sources import tables, variant

# ---------------------------------------------------------------- layouts
_DAYS, _STORES = ("1996-03-01", "1996-09-30"), (3, 4)


def _clustered(spark: SparkSession, root: str, path: str) -> dict[str, DataFrame]:
    """The index of each layout of the lines, 16 files each: linear in (day, store), and by interleaved bits of both."""
    from .sources import ingest

    lines, keys = tables.table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_extendedprice"), ["l_shipdate", "l_suppkey"]
    ingest.write_clustered(lines, f"{path}/linear", keys, 16)
    layout.write_z_ordered(lines, f"{path}/z", keys, 16)
    for name in ("linear", "z"):
        layout.write_file_index(spark, f"{path}/{name}", keys, f"{path}/{name}_index")
    return {name: spark.read.parquet(f"{path}/{name}_index") for name in ("linear", "z")}


@query(None, f"SELECT layout, count(*) AS rows, {sum_of('l_extendedprice', 2)} AS amount, TRUE AS fewer_files FROM lineitem, (SELECT unnest(['linear', 'z']) AS layout) WHERE l_suppkey BETWEEN {_STORES[0]} AND {_STORES[1]} GROUP BY layout")
def z_order_second_key(spark, root):
    """A range of the second key read through the file index of each layout; interleaved, it lies in fewer files than in the linear one."""
    path = rank.stage_dir(spark)
    index, span = _clustered(spark, root, path), {"l_suppkey": _STORES}
    opened = {name: len(layout.files_for(i, span)) for name, i in index.items()}
    fewer = {"linear": opened["linear"] == index["linear"].count(), "z": opened["z"] < opened["linear"]}  # the linear layout opens all
    out = [
        layout.read_range(spark, f"{path}/{name}", i, span).agg(F.count("*").alias("rows"), C.money_sum("l_extendedprice", 2).alias("amount")).select(F.lit(name).alias("layout"), "*", F.lit(fewer[name]).alias("fewer_files"))
        for name, i in index.items()
    ]
    return out[0].unionByName(out[1])


@query(None, f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey BETWEEN {_STORES[0]} AND {_STORES[1]} AND l_shipdate BETWEEN TIMESTAMP '{_DAYS[0]}' AND TIMESTAMP '{_DAYS[1]}'")
def z_order_both_keys(spark, root):
    """Rows of a range of both keys, from the few files that may hold them."""
    path = rank.stage_dir(spark)
    span = {"l_suppkey": _STORES, "l_shipdate": tuple(F.lit(d).cast("timestamp") for d in _DAYS)}
    return layout.read_range(spark, f"{path}/z", _clustered(spark, root, path)["z"], span).select("l_orderkey", "l_linenumber")


@query("promo", _BY_STORE)
def bucketed_merge_join(spark, root):
    """The composite merge join over tables that are bucketed alike, so that neither side is shuffled."""
    keys, path, run = ["product_id", "supplier_id", "week_no"], rank.stage_dir(spark), uuid.uuid4().hex
    lines = tables.deliveries(spark, root).select(*keys, "sales_amt")
    promo = flags(spark, root).withColumnRenamed("store_id", "supplier_id").select(*keys, "on_display")
    left, right = (layout.write_bucketed(df, f"{name}_{run}", f"{path}/{name}", keys, 8) for name, df in (("lines", lines), ("promo", promo)))
    joined = left.join(right.hint("merge"), keys)
    return joined.groupBy("supplier_id").agg(F.count("*").alias("lines"), F.count(F.when(F.col("on_display"), 1)).alias("displayed"), C.money_sum("sales_amt", 2).alias("revenue"))


# ---------------------------------------------------------------- heavy hitters
@query(None, _JOINED)
def hot_salted_join(spark, root):
    """The salted join with a salt for the suppliers alone that hold more than a hundredth of the lines."""
    lines = skewed(spark, root)
    return _by_hot(skew.hot_salted_join(lines, _suppliers(spark, root), ["l_suppkey"], ["l_orderkey", "l_linenumber"], 8, skew.hot_keys(lines, ["l_suppkey"], 0.01)))


_HELD = f"(SELECT hot, count(*) AS n FROM {_SKEWED} GROUP BY hot)"


@query(None, f"SELECT count(*) AS right_rows, count(*) + 7 * count(*) FILTER (n > 0.05 * total) AS after_salting, count(*) FILTER (n > 0.05 * total) AS hot_keys FROM {_HELD}, (SELECT count(*) AS total FROM lineitem)")
def hot_salting_growth(spark, root):
    """By how many rows the right side of a salted join grows if the hot keys alone are repeated eight times."""
    lines = skewed(spark, root)
    hot = skew.hot_keys(lines, ["hot"], 0.05)
    right = lines.select("hot").distinct()
    grown = skew.hot_salted_join(right.withColumn("side", F.lit(1)), right, ["hot"], ["side"], 1, [])  # every key once
    repeated = F.when(F.xxhash64("hot").isin(hot), F.sequence(F.lit(0), F.lit(7))).otherwise(F.array(F.lit(0)))
    after = grown.select(F.explode(repeated).alias("s")).agg(F.count("*").alias("after_salting"))
    return grown.agg(F.count("*").alias("right_rows")).crossJoin(after).withColumn("hot_keys", F.lit(len(hot)).cast("bigint"))


@query(None, f"SELECT hot, count(*) AS rows, {sum_of('l_extendedprice', 2)} AS amount, count(DISTINCT l_partkey) AS distinct_values FROM {_SKEWED} GROUP BY hot")
def hot_salted_distinct(spark, root):
    lines = skewed(spark, root)
    return skew.hot_salted_agg(lines, "hot", "l_partkey", "l_extendedprice", 16, skew.hot_keys(lines, ["hot"]))


# ---------------------------------------------------------------- sketches
_PARSED = "event_id % 997 <> 5"
_GRAINS = {"day": "CAST(date_trunc('day', ts) AS VARCHAR)", "week": "CAST(date_trunc('week', ts) AS VARCHAR)", "all": "'all'"}


@query(None, " UNION ALL ".join(f"SELECT '{g}' AS grain, {e} AS period, count(*) AS rows, count(DISTINCT user_id) AS users, TRUE AS within_error FROM events WHERE {_PARSED} GROUP BY 2" for g, e in _GRAINS.items()))
def distinct_rollup(spark, root):
    """Users of a day, a week and of all, rolled up from sketches that were stored for each ingested file and day, beside exact counts."""
    path = rank.stage_dir(spark)
    rows = rank.staged(_landed(spark, root, path).where("event_id is not null").select("_source_file", F.date_trunc("day", "ts").alias("day"), "user_id"))
    sketches.distinct_sketches(rows, ["_source_file", "day"], "user_id").write.parquet(f"{path}/sketches")
    stored, out = spark.read.parquet(f"{path}/sketches"), None
    text = lambda unit: F.date_format(F.date_trunc(unit, "day"), "yyyy-MM-dd HH:mm:ss")
    for grain, period in {"day": text("day"), "week": text("week"), "all": F.lit("all")}.items():
        near = sketches.rolled_up(stored.withColumn("period", period), ["period"])
        exact = rows.groupBy(period.alias("period")).agg(F.countDistinct("user_id").alias("users"))
        one = near.join(exact, "period").select(F.lit(grain).alias("grain"), "period", "rows", "users", sketches.within_error("estimate", "users").alias("within_error"))
        out = one if out is None else out.unionByName(one)
    return out


@query(None, f"SELECT CASE WHEN event_id > (SELECT trunc(quantile_cont(event_id, 0.5))::BIGINT FROM events) THEN 1 ELSE 0 END AS run, count(*) AS rows, count(DISTINCT user_id) AS users, TRUE AS within_error, TRUE AS files_in_order FROM events WHERE {_PARSED} GROUP BY 1")
def file_health(spark, root):
    """Health of each source file (rows, users by sketch, range of ingest times), and what its files say of each run."""
    rows = _landed(spark, root, rank.stage_dir(spark)).where("event_id is not null")
    ends = [F.min("_ingest_ts").alias("first_ingest"), F.max("_ingest_ts").alias("last_ingest"), F.max("_source_file_ts").alias("written")]
    files = rows.groupBy("_source_file", "batch").agg(F.count("*").alias("rows"), F.hll_sketch_agg("user_id", sketches.LOG_REGISTERS).alias("sketch"), *ends)
    in_order = (F.col("written") <= F.col("first_ingest")) & (F.col("first_ingest") <= F.col("last_ingest"))
    runs = files.groupBy(F.col("batch").cast("int").alias("run")).agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"), F.bool_and(in_order).alias("files_in_order"))
    exact = rows.groupBy(F.col("batch").cast("int").alias("run")).agg(F.countDistinct("user_id").alias("users"))
    return runs.join(exact, "run").select("run", "rows", "users", sketches.within_error("estimate", "users").alias("within_error"), "files_in_order")


@query(None, "SELECT TRUE AS near_exact, (SELECT count(*) FROM orders WHERE o_orderdate < DATE '1998-01-01')::BIGINT AS base_rows, (SELECT count(*) FROM orders WHERE o_orderdate >= DATE '1998-01-01')::BIGINT AS now_rows")
def drift_from_sketches(spark, root):
    """Drift of order prices between two periods, from a stored quantile sketch of each, against the figure from all rows.

    The bound: a share moves by twice the sketch's rank error at each of its two ends, over ten bins.
    """
    path, rows = rank.stage_dir(spark), tables.table(spark, root, "orders").where("o_totalprice is not null")
    period = F.when(F.col("o_orderdate") < F.lit("1998-01-01"), "base").otherwise("now")
    sketches.quantile_sketches(rows.withColumn("period", period), ["period"], "o_totalprice").write.parquet(f"{path}/sketches")
    stored = spark.read.parquet(f"{path}/sketches")
    base, now = stored.where("period = 'base'"), stored.where("period = 'now'")
    exact = features.population_stability(rows.where("o_orderdate < date'1998-01-01'"), rows.where("o_orderdate >= date'1998-01-01'"), "o_totalprice")
    near = sketches.sketch_stability(base, now).select(F.col("psi").alias("near")).crossJoin(exact)
    counts = base.select(F.col("rows").alias("base_rows")).crossJoin(now.select(F.col("rows").alias("now_rows")))
    return near.select((F.abs(F.col("near") - F.col("psi")) <= 10 * 2 * 2 * sketches.RANK_ERROR).alias("near_exact")).crossJoin(counts)


# ---------------------------------------------------------------- variants
def _lines(spark: SparkSession, root: str) -> DataFrame:
    """Events as JSON lines whose nested fields drift: props as they are, for a fifth with an object in them; some values are texts."""
    value = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('"'), F.col("value").cast("string"), F.lit(' units"'))).otherwise(F.col("value").cast("string"))
    props = F.when(F.col("event_id") % 5 == 0, F.concat(F.regexp_replace("props", "\\}\\s*$", ""), F.lit(', "extra": {"deep": ['), (F.col("event_id") % 9).cast("string"), F.lit(", 0]}}"))).otherwise(F.col("props"))
    kind = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(', "kind": "'), F.col("event_type"), F.lit('"'))).otherwise(F.lit(""))
    line = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "value": '), value, F.lit(', "props": '), props, kind, F.lit("}"))
    return tables.table(spark, root, "events").select(F.when(F.col("event_id") % 997 == 5, F.lit("{broken")).otherwise(line).alias("value"))


_OK = "event_id % 997 <> 5"


@query(None, f"""SELECT event_id % 7 = 0 AS retyped, count(*) AS rows, count(*) FILTER (NOT ({_OK})) AS broken, count(*) FILTER ({_OK} AND event_id % 7 <> 0) AS typed_values, count(*) FILTER ({_OK} AND event_id % 7 = 0) AS rescued_values,
  (sum((props->>'k')::BIGINT) FILTER ({_OK}))::BIGINT AS k, (coalesce(sum(event_id % 9) FILTER ({_OK} AND event_id % 5 = 0), 0))::BIGINT AS deep, count(*) FILTER ({_OK} AND event_id % 2 = 0) AS kinds FROM events WHERE {_OK} GROUP BY 1
UNION ALL SELECT NULL, count(*), count(*), 0, 0, NULL, 0, 0 FROM events WHERE NOT ({_OK}) HAVING count(*) > 0""")
def variant_rescue(spark, root):
    """Nested and retyped fields typed from lines that were parsed once; broken lines are kept, values that do not fit are rescued."""
    rows = variant.typed(variant.parsed(_lines(spark, root)), {"id": "bigint", "value": "double", "props.k": "bigint", "props.extra.deep[0]": "bigint", "kind": "string"})
    return rows.groupBy((F.col("id") % 7 == 0).alias("retyped")).agg(
        F.count("*").alias("rows"), F.count("_broken").alias("broken"), F.count("value").alias("typed_values"), F.count(F.col("_rescued")["value"]).alias("rescued_values"),
        F.sum("props_k").alias("k"), F.coalesce(F.sum("props_extra_deep_0"), F.lit(0)).alias("deep"), F.count("kind").alias("kinds"),
    )


@query(None, f"SELECT f.* FROM (SELECT 'id' AS field, 'BIGINT' AS type, count(*) AS rows FROM events WHERE {_OK} UNION ALL SELECT 'value', 'VARIANT', count(*) FROM events WHERE {_OK} UNION ALL SELECT 'props', 'OBJECT<extra: OBJECT<deep: ARRAY<BIGINT>>, k: BIGINT>', count(*) FROM events WHERE {_OK} UNION ALL SELECT 'kind', 'STRING', count(*) FROM events WHERE {_OK} AND event_id % 2 = 0) f WHERE rows > 0")
def variant_fields(spark, root):
    """Fields of all lines and the narrowest type that holds their values, nested ones too."""
    return variant.fields(variant.parsed(_lines(spark, root)))
