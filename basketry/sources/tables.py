"""Readers of the given tables, and their mapping onto the retail model."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The session setting that names the folder of the tables where a caller gives none.
ROOT_SETTING = "spark.basketry.root"


def place(spark: SparkSession, root: str | None, name: str) -> str:
    """Where a table lies: in ``root``, else in the folder that the session names."""
    base = root or spark.conf.get(ROOT_SETTING, None)
    if not base:
        raise ValueError(f"no folder for {name}: give one, or set {ROOT_SETTING}")
    return f"{base.rstrip('/')}/{name}.parquet"


def table(spark: SparkSession, root: str | None, name: str) -> DataFrame:
    return spark.read.parquet(place(spark, root, name))


def table_stream(spark: SparkSession, root: str | None, name: str) -> DataFrame:
    """The same table as a stream of what its file or folder holds."""
    folder, file = place(spark, root, name).rsplit("/", 1)
    return spark.readStream.schema(table(spark, root, name).schema).option("pathGlobFilter", file).parquet(folder)


def conform(df: DataFrame, spec: list[tuple[str, str, Column | str]]) -> DataFrame:
    """df as a table of (name, type, expression) columns, in that order and no others.

    A value that does not fit its type is an error where the session's ANSI mode is on; wrap it in ``try_cast`` to have null.
    """
    twice = [n for n, k in Counter(name for name, _, _ in spec).items() if k > 1]
    if twice:
        raise ValueError(f"columns given twice: {twice}")
    return df.select(*((F.expr(e) if isinstance(e, str) else e).cast(kind).alias(name) for name, kind, e in spec))


def spec_ddl(spec: list[tuple[str, str, Column | str]]) -> str:
    """The schema of a specification as DDL."""
    return ", ".join(f"`{name}` {kind}" for name, kind, _ in spec)


#: Bytes of a table's files that make one partition where it is shuffled; some four times as much, as shuffled rows are less packed.
PARTITION_BYTES = 16 << 20
#: Bytes of orders from which their two columns are no broadcast.
SHUFFLED_BYTES = 160 << 20


def table_bytes(spark: SparkSession, root: str | None, name: str) -> int:
    """The size of a table's file or folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place(spark, root, name))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def delivered(spark: SparkSession, root: str, by_basket: bool = False) -> DataFrame:
    """Rows of lineitem with their order's customer, as they were delivered.

    Where rows are shuffled, as they are for a caller that needs them ``by_basket`` or for a join with many orders, a large table
    is dealt over as many partitions as its size asks for, if those are more than the session's; so a task's share stays bounded.
    """
    order = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    lines, parts = table(spark, root, "lineitem"), -(-table_bytes(spark, root, "lineitem") // PARTITION_BYTES)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) and (by_basket or table_bytes(spark, root, "orders") > SHUFFLED_BYTES):
        lines = lines.repartition(parts, "l_orderkey")
    return lines.join(order, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


def quantity_text() -> Column:
    """The quantity of a delivered row as it was sent: some with their unit."""
    sent = F.col("l_quantity").cast("bigint").cast("string")
    return F.when(F.col("l_partkey") % 13 == 0, F.concat(sent, F.lit(" units"))).otherwise(sent)


def deliveries(spark: SparkSession, root: str) -> DataFrame:
    """Delivered basket lines. An event_id may be delivered several times."""
    return basket_lines(delivered(spark, root))


def basket_lines(rows: DataFrame) -> DataFrame:
    """Delivered rows as basket lines.

    Some lines carry defects by rule, so that gates have something to reject: no store, negative or text quantities,
    a surcharge for a discount, a time that is none.
    """
    part, supp, key = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    discount = F.col("l_extendedprice") * F.col("l_discount")
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"),
        key.alias("basket_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("o_custkey").alias("household_key"),
        F.when(part % 211 != 7, supp).alias("store_id"),
        part.alias("product_id"),
        quantity_text().alias("quantity_raw"),
        F.when(part % 307 == 5, -F.col("l_quantity").cast("bigint")).otherwise(F.col("l_quantity").cast("bigint")).alias("quantity_units"),
        F.col("l_extendedprice").alias("sales_amt"),
        F.when(part % 401 == 9, discount).otherwise(-discount).alias("retail_disc_amt"),
        F.when(F.col("l_returnflag") == "R", -F.col("l_tax")).otherwise(F.lit(0.0)).alias("coupon_disc_amt"),
        F.lit(0.0).alias("coupon_match_disc_amt"),
        F.when(key % 2 == 0, (key % 24 * 100 + part % 61).cast("int")).alias("trans_time"),
        F.when(key % 2 == 1, (key % 24 * 100 + part % 61).cast("int")).alias("transaction_time"),
        F.col("l_shipdate").alias("transaction_ts"),
        (F.floor(F.datediff("l_shipdate", F.lit("1995-01-01")) / 7) + 1).cast("int").alias("week_no"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"),
        supp.alias("supplier_id"),
    )


def promotions(spark: SparkSession, root: str) -> DataFrame:
    """A sparse promotion table with repeated keys: product, store, week and two codes."""
    return promotions_of(deliveries(spark, root))


def promotions_of(lines: DataFrame) -> DataFrame:
    """The promotion table of delivered lines that a caller has already."""
    rows = lines.where("product_id % 5 = 0 and supplier_id is not null")
    return rows.select("product_id", F.col("supplier_id").alias("store_id"), "week_no", F.col("return_flag").alias("display"), F.col("line_status").alias("mailer"))


def product_changes(spark: SparkSession, root: str) -> DataFrame:
    """A change feed of products: one version each, a second for some, and a re-delivery that changes nothing."""
    part = table(spark, root, "part")
    base = part.select(F.col("p_partkey").alias("product_id"), F.col("p_type").alias("department"), F.col("p_brand").alias("brand_tier"))
    first = base.withColumn("changed_at", F.lit("1990-01-01").cast("timestamp"))
    again = base.where("product_id % 10 = 3").withColumn("changed_at", F.lit("1994-01-01").cast("timestamp"))
    second = base.where("product_id % 50 = 7").withColumns({"department": F.lit("MOVED"), "changed_at": F.lit("1998-01-01").cast("timestamp")})
    return first.unionByName(again).unionByName(second)


def household_changes(spark: SparkSession, root: str) -> DataFrame:
    """A change feed of households: all from the start, some enrol, some of those are updated."""
    from ..operators.scd2 import snapshot_versions

    at = lambda segment, day: F.struct(segment.alias("segment"), F.lit(day).cast("timestamp").alias("changed_at"))
    base = table(spark, root, "customer").select(F.col("c_custkey").alias("household_key"), F.col("c_mktsegment").alias("segment"))
    enrolled = F.col("household_key") % 3 == 0
    updated = enrolled & (F.col("household_key") % 20 == 3)
    versions = [at(F.lit("UNKNOWN"), "1990-01-01"), F.when(enrolled, at(F.col("segment"), "1997-07-01")), F.when(updated, at(F.concat(F.lit("UPD-"), "segment"), "1999-03-01"))]
    return snapshot_versions(base, ["household_key"], versions)
