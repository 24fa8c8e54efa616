"""Contracts of the operators on small hand-made frames."""

import datetime as dt
import json
import shutil

import pytest
from basketry.functions import columns as C
from basketry.operators import audits, dedupe, rank, rules, sample, scd2, skew
from basketry.plans import features, lookups, metrics, model
from basketry.sources import ingest
from basketry.streaming import flows
from pyspark.sql import functions as F


def ts(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


CHANGES = [("A", "x", ts(1)), ("A", "y", ts(5)), ("A", "y", ts(9)), ("B", None, ts(1)), ("B", "q", ts(4)), ("C", "z", ts(1))]


@pytest.fixture(scope="module")
def dim(spark):
    return scd2.build_scd2(spark.createDataFrame(CHANGES, "k string, v string, at timestamp"), ["k"], "at", ["v"])


def test_versions_fold_redelivery_and_close_windows(spark, dim):
    got = {(r.k, r.v, r.valid_from.day, r.valid_to and r.valid_to.day, r.is_current) for r in dim.collect()}
    assert got == {("A", "x", 1, 5, False), ("A", "y", 5, None, True), ("B", None, 1, 4, False), ("B", "q", 4, None, True), ("C", "z", 1, None, True)}
    again = scd2.build_scd2(spark.createDataFrame(CHANGES[::-1], "k string, v string, at timestamp").repartition(3), ["k"], "at", ["v"])
    assert audits.two_way_difference(dim, again).count() == 0
    assert scd2.overlapping_windows(dim, ["k"]).count() == 0 and scd2.open_version_violations(dim, ["k"]).count() == 0


def test_point_in_time_join_is_one_to_one_where_the_key_join_is_not(spark, dim):
    facts = spark.createDataFrame([("e1", "A", ts(2), 10.0), ("e2", "A", ts(5), 20.0), ("e3", "A", ts(9), 30.0), ("e4", "B", ts(3), 40.0), ("e5", "B", ts(6), 50.0), ("e6", "C", ts(2), 60.0)], "id string, k string, at timestamp, amt double")
    got = {r.id: r.v for r in scd2.as_of_join(facts, dim, ["k"], "at", "inner", ["v"]).collect()}
    assert got == {"e1": "x", "e2": "y", "e3": "y", "e4": None, "e5": "q", "e6": "z"}
    report = {r.join_kind: (r.rows, r.total) for r in scd2.fanout_report(facts, dim, ["k"], "at", "amt").collect()}
    assert report == {"key_only": (11, 360.0), "point_in_time": (6, 210.0)}
    early = facts.unionByName(spark.createDataFrame([("e0", "A", dt.datetime(2023, 1, 1), 1.0)], facts.schema))
    assert [r.id for r in scd2.orphans(early, dim, ["k"], "at").collect()] == ["e0"]
    assert scd2.as_of_join(early, dim, ["k"], "at").count() == 7


def test_overlap_is_found_even_when_not_adjacent(spark):
    rows = [(1, ts(1), ts(20)), (1, ts(2), ts(3)), (1, ts(5), ts(6)), (2, ts(1), ts(2)), (2, ts(2), None)]
    frame = spark.createDataFrame(rows, "k int, valid_from timestamp, valid_to timestamp")
    assert sorted((r.k, r.valid_from.day) for r in scd2.overlapping_windows(frame, ["k"]).collect()) == [(1, 2), (1, 5)]


def test_latest_is_the_same_under_any_partitioning(spark):
    rows = [(1, "a", 1.0), (1, "b", 2.0), (2, "a", 1.0), (None, "a", 3.0), (1, "b", 2.5)]
    frame = spark.createDataFrame(rows, "k int, f string, v double")
    seen = {tuple(sorted(map(str, dedupe.latest_per_key(frame.repartition(n), ["k"], ["f"]).collect()))) for n in (1, 2, 3, 4)}
    assert len(seen) == 1 and len(seen.pop()) == 3


BASE = dict(event_id="e", store_id=1, product_id=1, household_key=1, week_no=5, quantity_units=2, transaction_time_hhmm=930, sales_amt=3.0, retail_disc_amt=-1.0, coupon_disc_amt=0.0, coupon_match_disc_amt=0.0, transaction_ts=ts(1))
SCHEMA = "event_id string, store_id long, product_id long, household_key long, week_no int, quantity_units long, transaction_time_hhmm int, sales_amt double, retail_disc_amt double, coupon_disc_amt double, coupon_match_disc_amt double, transaction_ts timestamp"
BAD = [
    ("event_id_present", dict(event_id=None)), ("transaction_time_reconciled", dict(transaction_time_hhmm=None)), ("transaction_time_is_valid_hhmm", dict(transaction_time_hhmm=1373)), ("quantity_parsed", dict(quantity_units=None)),
    ("quantity_non_negative", dict(quantity_units=-1, sales_amt=0.0, retail_disc_amt=-1.0)), ("revenue_requires_quantity", dict(quantity_units=0)), ("sales_amt_present", dict(sales_amt=None)), ("sales_amt_non_negative", dict(sales_amt=-1.0)),
    ("discount_amounts_present", dict(coupon_disc_amt=None)), ("retail_discount_is_not_a_surcharge", dict(retail_disc_amt=1.0)), ("coupon_discounts_are_not_surcharges", dict(coupon_match_disc_amt=1.0)), ("store_id_present", dict(store_id=None)),
    ("product_id_present", dict(product_id=None)), ("household_key_present", dict(household_key=None)), ("transaction_ts_present", dict(transaction_ts=None)), ("transaction_ts_not_in_future", dict(transaction_ts=dt.datetime(2999, 1, 1))),
]


def test_each_rule_rejects_its_own_bad_row_and_legal_outliers_pass(spark):
    table = rules.rules_table(spark, rules.FACT_RULES)
    found = rules.load_rules(table, "fact")
    good = [BASE, BASE | dict(quantity_units=89_638), BASE | dict(sales_amt=0.0), BASE | dict(week_no=300)]
    data = [dict(b, event_id=b["event_id"] and f"g{i}") for i, b in enumerate(good)] + [BASE | change for _, change in BAD]
    valid, rejected = rules.gate(spark.createDataFrame([tuple(d[f.split()[0]] for f in SCHEMA.split(", ")) for d in data], SCHEMA), found)
    assert sorted(r.event_id for r in valid.collect()) == ["g0", "g1", "g2", "g3"]
    named = [set(r.failed_rules) for r in rejected.collect()]
    assert len(named) == len(BAD) and all(any(n in s for s in named) for n, _ in BAD)
    assert {r.rule_name for r in rejected.collect()} <= {n for n, _ in BAD}
    with pytest.raises(ValueError):
        rules.load_rules(table.where("false"), "fact")


def test_unreviewed_candidates_are_reported(spark):
    a, b = spark.createDataFrame([("p",), ("q",)], "name string"), spark.createDataFrame([("q",), ("r",)], "name string")
    assert sorted(map(tuple, rules.unreviewed(a, b).collect())) == [("p", "undecided"), ("r", "unknown")]


def test_columns(spark):
    rows = [("12 units", None, 930), ("7", 5, 2460), ("many", 7, 1373), (None, None, None)]
    value, source = C.reconciled("a", "b")
    frame = spark.createDataFrame(rows, "q string, a int, b int")
    got = frame.select(C.leading_number("q").alias("n"), C.number_format("q").alias("f"), value.alias("v"), source.alias("s"), C.hhmm_timestamp(F.lit("2024-01-01").cast("date"), "b").alias("t"), C.or_member("q", "NONE").alias("m")).collect()
    assert [(r.n, r.f, r.v, r.s) for r in got] == [(12, "unit_suffixed", 930, "b"), (7, "numeric", 5, "a"), (None, "unparsed", 7, "a"), (None, None, None, "missing")]
    assert got[0].t == ts(1).replace(hour=9, minute=30) and got[1].t is None and got[2].t is None and got[3].m == "NONE"
    label = spark.createDataFrame([(None, True, True), (5, True, True), (10, True, None), (10, None, True), (10, True, True), (10, None, None)], "w int, d boolean, m boolean")
    assert [r[0] for r in label.select(C.exposure_label("w", "d", "m", 9, 20)).collect()] == ["unknown", "unknown", "display", "mailer", "both", "not_promoted"]


def test_metric_layer_rejects_what_it_must(spark):
    m = metrics.Measure
    with pytest.raises(ValueError):
        metrics.check_registry([metrics.view("a", [], [m("x", lambda: F.count("*"))]), metrics.view("b", [], [m("x", lambda: F.count("*"))])])
    with pytest.raises(ValueError):
        metrics.check_registry([metrics.view("a", [], [m("r", derived=lambda d: d["elsewhere"], needs=("elsewhere",))])])
    with pytest.raises(KeyError):
        metrics.metric_query(spark.range(3), metrics.COMMERCIAL, ["sales_amt"])
    metrics.check_registry([metrics.COMMERCIAL, metrics.HOUSEHOLD])


def test_lookups_check_arguments(spark):
    lookups.register(spark, {"promo_performance": spark.createDataFrame([(1, 2, "both", 1.0, 1, 1)], "product_id long, week_no int, promo_exposure string, sales_amt double, baskets long, stores long")})
    assert lookups.lookup(spark, "promo_lookup", product=1, week=2).count() == 1
    assert lookups.lookup(spark, "promo_lookup", product=9, week=2).count() == 0
    with pytest.raises(TypeError):
        lookups.lookup(spark, "promo_lookup", product="1 OR 1=1", week=2)
    with pytest.raises(TypeError):
        lookups.lookup(spark, "promo_lookup", product=1)


def test_salted_equals_plain_and_rank_equals_window(spark):
    left = spark.range(500).selectExpr("id", "if(id < 400, 0, id) as k", "id * 1.5 as v")
    right = spark.range(0, 500, 2).selectExpr("id as k", "id as w")
    assert audits.two_way_difference(skew.salted_join(left, right, ["k"], ["id"], 7).select("id", "w"), left.join(right, "k").select("id", "w")).count() == 0
    got = {r.k: r.distinct_values for r in skew.salted_agg(left, "k", "id", "v").collect()}
    assert got[0] == 400 and len(got) == 101
    numbered = rank.distributed_row_number(left.repartition(5), [F.desc("id")], "n", 4).collect()
    assert all(r.n == 500 - r.id for r in numbered) and len(numbered) == 500
    assert skew.partition_skew(left, ["k"], [4], 8).first().max_rows >= 400


def test_scores(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, s double")
    assert model.roc_auc(rows, "y", "s").first()[0] == 0.875
    assert model.average_precision(rows, "y", "s").first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3, abs=1e-6)


def test_bootstrap_keeps_groups_whole_and_is_repeatable(spark):
    lines = spark.createDataFrame([(g, i, float(g)) for g in range(20) for i in range(g % 4 + 1)], "g int, i int, a double")
    for weight in (None, "a"):
        a, b = (sample.bootstrap_groups(lines, "g", 50, 3, weight) for _ in range(2))
        assert a.select("draw_id").distinct().count() == 50 and sample.broken_groups(a, lines, "g", "draw_id", "i", "a").count() == 0
        assert audits.two_way_difference(a, b).count() == 0
    assert sample.total_variation(lines, lines, "g").first()[0] == 0


def test_expectations_count_and_stop(spark):
    frame, seen = audits.expect(spark.range(10), "r", {"small": "id < 7"})
    frame.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "small": 3}
    with pytest.raises(Exception, match="too large"):
        audits.fail_on(spark.range(10), "id < 7", "too large").count()
    assert audits.fail_on(spark.range(3), "id < 7", "too large").count() == 3


def test_run_log_rolls_up_cumulative_counters(spark):
    details = [json.dumps({"expectations": [{"name": "n", "dataset": "d", "passed": p, "failed": p // 10}]}) for p in (10, 20, 30, 5)]
    events = [("flow_progress", ("u", b), x) for b, x in zip((1, 1, 1, 2), details)] + [("other", ("u", 3), "{}")]
    log = audits.parse_run_log(spark.createDataFrame(events, "event_type string, origin struct<update_id:string,batch_id:int>, details string"))
    assert [(r.passed, r.failed) for r in audits.dq_metrics(log).collect()] == [(35, 3)]
    assert audits.failures_by_rule(log).first().failures == {"n": 3}


def test_upsert_replay_and_late_versions(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        return spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")

    schema = "id string, amt double, seen timestamp, file string"
    first = [("a", 1.0, ts(1), "f1"), ("b", 2.0, ts(1), "f1")]
    for more in (first, [("a", 1.0, ts(1), "f2"), ("b", 2.0, ts(1), "f0")], [("c", 4.0, ts(2), "f3")]):
        flows.upsert_stream(put("in", more, schema), f"{tmp_path}/t", ["id"], ["seen", "file"], f"{tmp_path}/c", 4)
    got = {r.id: (r.amt, r.file) for r in spark.read.parquet(f"{tmp_path}/t").collect()}
    assert got == {"a": (1.0, "f2"), "b": (2.0, "f1"), "c": (4.0, "f3")}
    changes = "k string, v string, at timestamp"
    for more in ([("A", "x", ts(1)), ("A", "z", ts(9))], [("A", "y", ts(5)), ("A", "x", ts(1))]):
        flows.scd2_stream(put("cdc", more, changes), f"{tmp_path}/log", f"{tmp_path}/dim", ["k"], "at", ["v"], f"{tmp_path}/c2", 4)
    got = sorted((r.valid_from.day, r.v, r.valid_to and r.valid_to.day) for r in spark.read.parquet(f"{tmp_path}/dim").collect())
    assert got == [(1, "x", 5), (5, "y", 9), (9, "z", None)]


@pytest.mark.parametrize("dies", ["before the mark", "half way", "before the mark goes"])
def test_a_swap_cut_short_loses_no_row(spark, tmp_path, monkeypatch, dies):
    """The overwrite dies after old files are gone, or before anything is; the batch that runs again finds all rows."""
    path, schema = f"{tmp_path}/t", "id int, v int, seen int"
    merge = lambda rows: flows.merge_batch(spark.createDataFrame(rows, schema), path, ["id"], ["seen"], 4)
    merge([(i, 0, 1) for i in range(50)])
    promote, later = flows._promote, [(i, 1, 2) for i in range(40, 60)]

    def killed(staged, path):
        if dies == "half way":
            for folder in list((tmp_path / "t").glob("bucket=*"))[:3]:
                shutil.rmtree(folder)
        elif dies == "before the mark goes":
            promote(staged, path)
        raise RuntimeError("killed")

    if dies == "before the mark":
        monkeypatch.setattr(flows, "_replace_buckets", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    else:
        monkeypatch.setattr(flows, "_promote", killed)
    with pytest.raises(RuntimeError, match="killed"):
        merge(later)
    monkeypatch.undo()
    merge(later)
    got = {r.id: r.v for r in flows.read_table(spark, path).collect()}
    assert got == {i: int(i >= 40) for i in range(60)} and flows.read_table(spark, path).count() == 60


def test_gate_stream_loses_no_row(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 as v").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, v long").parquet(f"{tmp_path}/in")
    flows.split_stream(stream, [rules.Rule("small", "fact", "v < 5")], f"{tmp_path}/ok", f"{tmp_path}/bad", f"{tmp_path}/c")
    ok, bad = (spark.read.parquet(f"{tmp_path}/{d}").count() for d in ("ok", "bad"))
    assert ok + bad == 100 and bad == 28


def test_rescue_keeps_every_field(spark):
    lines = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": "1 units", "c": 2}',), ("{broken",), ('{"a": null}',)], "value string")
    got = ingest.typed(lines, {"a": "int", "b": "string"}, path=F.lit("f")).collect()
    assert [(r.a, r.b) for r in got] == [(1, "x"), (None, None), (None, None), (None, None)]
    assert got[0]._rescued_data is None and got[3]._rescued_data is None
    assert json.loads(got[1]._rescued_data) == {"a": "1 units", "c": "2", "_file_path": "f"}
    assert json.loads(got[2]._rescued_data) == {"_line": "{broken", "_file_path": "f"}


def test_csv_and_layout(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,y\n")
    ingest.csv_to_parquet(spark, f"{tmp_path}/x.csv", f"{tmp_path}/p", "a int, b string")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    ingest.write_clustered(spark.range(1000).selectExpr("id % 10 as k", "id"), f"{tmp_path}/q", ["k"], 4)
    assert ingest.file_stats(spark, f"{tmp_path}/q").first().files <= 4


def test_features_do_not_leak(spark):
    rows = [(1, 1, "s", 1, 2, 5.0, -1.0, 0.0, dt.datetime(2020, 1, d)) for d in (1, 5, 20)] + [(2, 2, "s", 1, 1, 5.0, 0.0, 0.0, dt.datetime(2020, 1, 2))]
    lines = spark.createDataFrame(rows, "household_key int, basket_id int, store_id string, product_id int, quantity_units long, sales_amt double, retail_disc_amt double, coupon_disc_amt double, transaction_ts timestamp")
    got = {r.household_key: r for r in features.lapse_features(lines, "2020-01-10").collect()}
    assert got[1].lapsed == 0 and got[2].lapsed == 1 and got[2].avg_days_between is None and got[1].recency_days == 9
    assert features.leakage_diff(lines, "2020-01-10").count() == 0


def test_models_find_what_was_planted(spark):
    """A label that hangs on one feature: that feature is the most important, and the model beats the baseline; the same again on a rerun."""
    from basketry.plans import model

    rows = spark.range(1200).select(
        (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("planted"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000).alias("noise"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 1000).alias("more_noise"), "id"
    ).withColumn("lapsed", ((F.col("planted") > 0.3) & (F.col("planted") < 0.7)).cast("int"))
    names = ["planted", "noise", "more_noise"]
    fitted = model.fit_gbt(rows.where("id % 4 > 0"), names, "lapsed")
    found = model.importance(fitted, names).collect()
    assert found[0].feature == "planted" and found[0].importance > 0.8
    assert [tuple(r) for r in model.importance(model.fit_gbt(rows.where("id % 4 > 0"), names, "lapsed"), names).collect()] == [tuple(r) for r in found]
    test = model.scored(fitted, rows.where("id % 4 = 0"), names, "lapsed")
    got = model.average_precision(test, "lapsed", "score")
    line = model.average_precision(test.withColumn("score", -F.col("planted")), "lapsed", "score")
    gate = model.lift_gate(got, line, "average_precision").first()
    assert gate.model_score > 0.95 and gate.passed


def test_stages_are_released(spark):
    import os

    from basketry.operators import rank

    rank.release_stages(spark)
    path = rank.stage_dir(spark).removeprefix("file:")
    spark.range(3).write.parquet(f"{path}/rows")
    assert os.path.isdir(path) and rank.release_stages(spark) == 1 and not os.path.exists(path) and rank.release_stages(spark) == 0
