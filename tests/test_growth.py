"""Work that grows no faster than the input: what is shuffled, how much one task holds."""

import datetime as dt
import decimal

from basketry import queries, queries_live
from basketry.operators import gold, profile, views
from basketry.plans import metrics
from basketry.sources import ingest, tables
from basketry.streaming import deltas, flows, live, versions
from pyspark.sql import functions as F

ROOT = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_latest_delivery_is_chosen_without_a_shuffle_of_lines(spark):
    """after a shuffled join with orders lines lie by basket; only the two inputs of that join are shuffled."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries.latest(spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2


def test_promo_performance_sends_each_line_on_once(spark):
    """no expanded rows; distinct counts with nulls, repeats and a null group."""
    rows = [(1, 7, None, "both", 1.5, 2, 10, 1, 5), (1, 7, None, "both", 1.0, 1, 10, 1, None), (1, 7, None, "both", 1.0, 1, 11, 1, 5), (2, 7, "d", "display", 1.0, None, None, None, None)]
    fact = spark.createDataFrame(rows, "week_no int, product_id long, department string, promo_exposure string, sales_amt double, quantity_units long, basket_id long, household_key long, store_id long")
    got = gold.promo_performance(fact)
    assert sorted(map(tuple, got.collect())) == [(1, 7, None, "both", 3.5, 4, 2, 1, 1), (2, 7, "d", "display", 1.0, None, 0, 0, 0)]
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_rollup_counts_distinct_values_without_a_row_for_each_level(spark):
    """every level's distinct counts, with null dimensions and values, as Spark's own rollup gives them."""
    rows = [(*("x" if i % 3 else None, "p" if i % 4 == 0 else "q"), i % 7 if i % 5 else None, i % 2, 1.5 * i, i) for i in range(60)] + [("only nulls", "r", None, None, 1.0, 1)]
    df = spark.createDataFrame(rows, "promo_exposure string, department string, basket_id long, household_key long, sales_amt double, quantity_units long").withColumns({"retail_disc_amt": F.lit(-1.0), "coupon_disc_amt": F.lit(0.0)})
    dims, names = ["promo_exposure", "department"], ["net_sales_amt", "baskets", "households", "avg_basket_amt"]
    got = metrics.metric_query(df, metrics.COMMERCIAL, names, dims, rollup=True)
    money = F.sum(F.col("sales_amt").cast("decimal(18,4)")).cast("double")
    want = df.rollup(*dims).agg(money.alias("s"), F.countDistinct("basket_id").alias("b"), F.countDistinct("household_key").alias("h")).withColumn("a", F.try_divide("s", F.col("b").cast("double")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "gid#" not in plan_of(got)  # the number that Spark gives the copies of a row


def test_lapse_features_read_the_joined_lines_once(spark):
    """the lines are worked out once, so no join with orders is left in the plan of the features."""
    plan = plan_of(queries.lapse(spark, ROOT))
    assert "orders.parquet" not in plan and "rows" in plan


def test_buckets_of_a_merged_table_hold_so_many_rows(spark, tmp_path):
    """deltas and bases have buckets by their rows, one a task, and look-ups still find theirs."""
    table = deltas.MergedTable(spark, str(tmp_path), ["k"], deltas.summed(["k"], ["n"]), compact_after=1, bucket_rows=100)
    rows = lambda low, high: spark.range(low, high).selectExpr("id as k", "1L as n")
    largest = lambda folder: spark.read.parquet(f"{tmp_path}/{folder}").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    table.add(rows(0, 2000), 0)
    assert largest("deltas/batch=0") < 200
    table.add(rows(1500, 3000), 1)
    assert table.manifest()["version"] == 1 and table.manifest()["buckets"] >= 30 and largest("base/v=1") < 200
    table.add(rows(10, 12), 2)
    assert {r.n for r in table.lookup(k=1700).collect()} == {2} and table.lookup(k=11).first().n == 2 and table.read().count() == 3000


def test_clustered_files_hold_so_many_rows(spark, tmp_path):
    """more files where few would be large; still sorted ranges."""
    ingest.write_clustered(spark.range(0, 5000, 1, 3), f"{tmp_path}/c", ["id"], 4, file_rows=250)
    files = ingest.file_ranges(spark, f"{tmp_path}/c", "id").orderBy("low").collect()
    assert len(files) >= 16 and all(a.high < b.low for a, b in zip(files, files[1:])) and spark.read.parquet(f"{tmp_path}/c").count() == 5000


def test_a_profile_keeps_one_column_at_a_time(spark):
    """blanks, nulls and repeats; no copies of rows with all columns."""
    df = spark.createDataFrame([(1, "a"), (1, " "), (None, None), (3, "a")], "x int, t string")
    got = profile.profile_table(df)
    assert sorted(map(tuple, got.collect())) == [("t", 4, 2, 2, None, None), ("x", 4, 1, 2, 1.0, 3.0)] and "Expand" not in plan_of(got)
    assert sorted(map(tuple, profile.profile_table(df.where("false")).collect())) == [("t", 0, 0, 0, None, None), ("x", 0, 0, 0, None, None)]


def test_a_keys_changes_cost_as_many_calls_as_one(monkeypatch):
    """calls to the state of a batch do not grow with the changes of a key."""
    from pyspark.sql.types import StringType, StructField, StructType

    calls = []

    class Store:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, *_):
            return Store()

        def registerTimer(self, at):
            calls.append("timer")

        deleteTimer = registerTimer

    each = versions._Versions("at", ["v"], StructType([StructField("v", StringType())]), ["k", "v", "valid_from", "valid_to"])
    each.init(Handle())
    hour = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    each.handleInputRows((1,), iter([{"at": hour(h), "v": str(h % 3)} for h in (5, 9, 7, 7, *range(20, 90))]), None)
    assert calls == ["get", "update", "timer"]
    each.handleInputRows((1,), iter([{"at": hour(3), "v": "x"}, {"at": hour(9), "v": None}]), None)
    assert calls[3:] == ["get", "update", "timer", "timer"]

    class Times:
        def getCurrentWatermarkInMs(self):
            return int(hour(8).timestamp() * 1000)

    got = [(r.v, r.valid_from, r.valid_to) for r in each.handleExpiredTimer((1,), Times(), None)]
    assert got == [("x", hour(3), None), ("x", hour(3), hour(5)), ("2", hour(5), None), ("2", hour(5), hour(7)), ("1", hour(7), None)]


def test_live_windows_start_one_query_and_bound_its_state(spark, monkeypatch):
    """F7, F8: no query for each part, which would load the state of all parts before; more parts for more rows, with the same windows."""
    started, exposed = [], live.exposed
    monkeypatch.setattr(live, "exposed", lambda *a: started.append(a) or exposed(*a))
    want = sorted(map(tuple, queries_live.stream_store_health(spark, ROOT).collect()), key=str)
    assert len(started) == 1 and want
    assert live.parts_for(spark, 1000, 3) == 3 and live.parts_for(spark, 4 * live.STATE_ROWS * 10 + 1, 3) == 11
    monkeypatch.setattr(live, "parts_for", lambda *_: 7)
    assert sorted(map(tuple, queries_live.stream_store_health(spark, ROOT).collect()), key=str) == want


def test_a_followed_query_sees_parts_in_order(spark, tmp_path):
    """F7, F8: a row behind the watermark is dropped, one in time meets its promotion; a part without rows lands as nothing."""
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    sales = spark.createDataFrame([(1, at(5), 0), (1, at(168), 0), (2, at(163), 1), (1, at(164), 1), (1, at(30), 1), (9, at(24 * 90), 3)], "k long, ts timestamp, part int")
    promos = spark.createDataFrame([(1, at(0), 0), (1, at(168), 0), (2, at(166), 1), (9, at(24 * 90), 3)], "k long, starts timestamp, part int")

    def start(streams):
        joined = live.exposed(streams["sales"], streams["promos"], ["k"], "ts", "starts", "7 DAYS", "6 hours", "6 hours")
        return flows.start_live(joined, f"{tmp_path}/out", f"{tmp_path}/checkpoint")

    live.follow(spark, {"sales": sales, "promos": lambda written: promos.where(F.lit(written["sales"].count() == 6))}, 4, str(tmp_path), start)
    got = spark.read.parquet(f"{tmp_path}/out").where("k < 9").select("k", "ts", "promoted").collect()
    assert sorted(map(tuple, got)) == [(1, at(5), True), (1, at(164), True), (1, at(168), True), (2, at(163), False)]


def test_lines_are_dealt_by_their_size(spark, monkeypatch):
    """F16: a large table is shuffled over more partitions than the session's, once, and gives the same lines."""
    want = sorted(map(tuple, queries.conformed(spark, ROOT).collect()), key=str)
    monkeypatch.setattr(tables, "PARTITION_BYTES", -(-tables.table_bytes(spark, ROOT, "lineitem") // 9))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold, shuffles in (("-1", 2), (before, 1)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = queries.conformed(spark, ROOT)
            plan = plan_of(got)
            assert got.rdd.getNumPartitions() == 9 and sorted(map(tuple, got.collect()), key=str) == want
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert plan.count("Exchange hashpartitioning") == shuffles


def test_a_view_writes_and_reads_a_batch_once(spark, tmp_path):
    """one table whatever is counted, a row a combination; a batch is shuffled once to be written, all is once to be read."""
    view = views.SumView(spark, str(tmp_path), ["g", "h"], ["x"], ["who", "what"], compact_after=1)
    schema = "g string, h long, x double, who long, what string, sign int"
    first = [("a", 1, 1.5, 1, "p", 1), ("a", 1, 1.5, 1, "q", 1), ("a", 1, 2.0, 2, "q", 1), ("a", 1, 2.0, 2, "q", 1), (None, 1, None, None, None, 1), ("b", None, 1.0, 3, None, 1)]
    then = [("a", 1, 1.5, 1, "p", -1), ("b", None, 1.0, 3, None, -1), ("a", 1, 4.0, None, "r", 1)]
    want = [[("a", 1, 4, 7.0, 2, 2), ("b", None, 1, 1.0, 1, 0), (None, 1, 1, 0.0, 0, 0)], [("a", 1, 4, 9.5, 2, 2), (None, 1, 1, 0.0, 0, 0)]]
    for number, rows in enumerate((first, then)):
        view.apply(spark.createDataFrame(rows, schema), number)
        assert sorted(map(tuple, view.read().collect()), key=str) == sorted(want[number], key=str)
    assert view.held.manifest()["version"] == 1 and [p.name for p in tmp_path.iterdir()] == ["held"]
    assert spark.read.parquet(f"{tmp_path}/held/deltas/batch=0").count() == 5
    assert plan_of(view.read()).count("Exchange hashpartitioning") == 1
    batch = view.held.merge(spark.createDataFrame(first, schema).select(*view.held.keys, *(F.col("sign").cast("long").alias(c) for c in ("lines", "_high_x", "_low_x"))))
    with deltas._dealt(spark, 7):
        assert plan_of(view.held._laid(batch, 7)).count("Exchange hashpartitioning") == 1


def test_sums_of_a_view_are_exact(spark, tmp_path):
    """sums in halves give the double nearest the exact total: large, small and negative values, and totals beyond a long."""
    view = views.SumView(spark, str(tmp_path), ["g"], ["x"], ["who"])
    large = decimal.Decimal("99999999999999.9999")
    rows = [*(("a", large, i) for i in range(2000)), *(("b", decimal.Decimal(i) / 10000 * (-1) ** i, i) for i in range(1, 400)), ("c", decimal.Decimal("-0.0001"), 1), ("c", decimal.Decimal("-100000.5"), 1), ("d", None, 1)]
    view.apply(spark.createDataFrame([(*r, 1) for r in rows], "g string, x decimal(18,4), who long, sign int"), 0)
    want = {g: float(sum((x or decimal.Decimal(0) for h, x, _ in rows if h == g), decimal.Decimal(0))) for g in "abcd"}
    assert {r.g: r.x for r in view.read().collect()} == want and want["a"] > 2**53


def test_changes_come_of_lines_read_once(spark):
    """no copy of the lines for each kind of change, and the changes leave what the correction asks for."""
    lines = spark.createDataFrame([(3, 5, 1.5, 2), (13, 16, 2.5, 1), (4, 4, 1.0, 1), (None, 7, 1.0, None), (8, 5, None, 3)], "product_id long, basket_id long, sales_amt double, quantity_units long")
    feed = queries_live._changes(lines)
    assert "Union" not in plan_of(feed) and feed.columns == [*lines.columns, "sign", "part"]
    left = feed.groupBy("product_id", "basket_id").agg(F.sum(F.col("sign") * F.col("quantity_units")).alias("units"), F.sum("sign").alias("n"))
    assert {(r.product_id, r.basket_id): (r.units, r.n) for r in left.collect()} == {(3, 5): (0, 0), (13, 16): (0, 0), (4, 4): (1, 1), (None, 7): (None, 1), (8, 5): (0, 0)}
    rows = [tuple(r) for r in feed.where("product_id = 3").orderBy("part", "sign").collect()]
    assert rows == [(3, 5, 1.5, 2, 1, 0), (3, 5, 1.5, 2, -1, 2), (3, 5, 2.5, 3, 1, 2), (3, 5, 2.5, 3, -1, 3)]
