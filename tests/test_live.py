"""Streams over several micro-batches: joined windows, the log of runs, merged tables, keyed versions, maintained views."""

import datetime as dt
import random

import pytest
from basketry import queries_live
from basketry.operators import scd2, views
from basketry.streaming import deltas, flows, live, runlog, versions
from pyspark.sql import functions as F

ROOT = "/root/testdata/sf0.001"
DAY = dt.datetime(2024, 1, 1)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_each_sale_comes_out_once_with_its_promotion_or_none(spark, tmp_path):
    sales = [(1, 1, at(5), 0), (1, 1, at(24 * 7), 0), (1, 2, at(6), 0), (None, 1, at(7), 0), (2, 1, at(163), 1), (1, 1, at(164), 1), (1, 1, at(30), 1), (9, 9, at(24 * 90), 2)]
    promos = [(1, 1, at(0), True, 0), (1, 1, at(24 * 7), False, 0), (2, 1, at(166), True, 0), (9, 9, at(24 * 90), True, 2)]
    sources = {"sales": spark.createDataFrame(sales, "product_id long, store_id long, ts timestamp, part int"), "promos": spark.createDataFrame(promos, "product_id long, store_id long, starts timestamp, on_display boolean, part int")}

    def run(streams, part):
        joined = live.exposed(streams["sales"], streams["promos"], ["product_id", "store_id"], "ts", "starts", "7 DAYS", "6 hours", "6 hours")
        flows.drain(joined, f"{tmp_path}/out", f"{tmp_path}/checkpoint")

    live.replay(sources, 3, str(tmp_path), run)
    got = rows_of(spark.read.parquet(f"{tmp_path}/out").where("product_id is null or product_id < 9").select("product_id", "store_id", "ts", "promoted", "on_display"))
    want = [(1, 1, at(5), True, True), (1, 1, at(24 * 7), True, False), (1, 2, at(6), False, None), (None, 1, at(7), False, None), (2, 1, at(163), False, None), (1, 1, at(164), True, True)]  # the sale of hour 30 came after the watermark of hour 162
    assert got == sorted(want, key=str)


def test_the_log_counts_what_a_watermark_drops(spark, tmp_path):
    """Five hours late is in, seven hours late is dropped and counted; a repeat is neither."""
    rows = [(1, at(24), 0), (2, at(23), 0), (3, at(24 - 5), 1), (4, at(24 - 7), 1), (2, at(23), 1), (5, at(25), 1)]
    source = spark.createDataFrame(rows, "event_id long, ts timestamp, part int")
    with runlog.RunLog(spark, f"{tmp_path}/log") as log:

        def run(streams, part):
            once = flows.deduplicated(streams["e"], ["event_id"], "ts", "6 hours").observe("kept", F.count(F.lit(1)).alias("rows"))
            log.finish(flows.start_drain(once, f"{tmp_path}/out", f"{tmp_path}/checkpoint", name=f"run-{part}"))

        live.replay({"e": source}, 2, str(tmp_path), run)
    log.batch("job", "lines", {"rows": 10, "small": 3})
    log.batch("job", "lines", {"rows": 10, "small": 4})  # reported again
    events = runlog.read_log(spark, f"{tmp_path}/log")
    found = {r.update_id: r for r in runlog.progress(events).collect()}
    assert {k: (r.input_rows, r.dropped_by_watermark, r.observed.get("kept.rows")) for k, r in found.items() if k != "job"} == {"run-0": (2, 0, 2), "run-1": (4, 1, 2)}
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3, 5]
    from basketry.operators import audits

    assert [(r.name, r.passed, r.failed) for r in audits.parse_run_log(events).collect()] == [("small", 6, 4)]


def test_some_rows_are_dropped_in_the_query(spark):
    got = queries_live.stream_run_log(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.dropped_late for r in got) > 0 and all(r.input_rows >= r.dropped_late + r.kept_rows for r in got)


def merged(spark, path, **settings):
    return deltas.MergedTable(spark, str(path), ["k"], deltas.latest(["k"], ["seq"]), **settings)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, seq long, v string")


def test_merged_table_replays_compacts_and_looks_up(spark, tmp_path):
    table, want, rng = merged(spark, tmp_path, compact_after=2, bucket_bytes=2000), {}, random.Random(3)
    for number in range(7):
        rows = [(rng.randrange(60), rng.randrange(1000) * 10 + number, f"v{rng.random()}") for _ in range(40)]
        for _ in range(2):  # a batch that comes again
            table.add(frame(spark, rows), number)
        for k, seq, v in rows:
            if (seq, v) > want.get(k, (-1, "")) and seq != want.get(k, (-1, ""))[0]:
                want[k] = (seq, v)
    got = {r.k: r.seq for r in table.read().collect()}
    assert got == {k: s for k, (s, _) in want.items()}
    assert table.manifest()["version"] >= 2 and table.manifest()["buckets"] > 1 and len(table.pending()) <= 2
    key = next(iter(want))
    assert [r.seq for r in table.lookup(k=key).collect()] == [want[key][0]] and table.lookup(k=-5).count() == 0
    table.vacuum()
    assert {r.k: r.seq for r in table.read().collect()} == got


def test_a_compaction_cut_short_changes_nothing(spark, tmp_path, monkeypatch):
    table = merged(spark, tmp_path)
    for number in range(3):
        table.add(frame(spark, [(i, number, "x") for i in range(number, 10)]), number)
    before = rows_of(table.read())
    with monkeypatch.context() as patch:
        patch.setattr(table, "_put", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            table.compact()
    assert rows_of(table.read()) == before and table.manifest()["version"] == 0
    table.compact()
    assert rows_of(table.read()) == before and table.pending() == []


def test_a_batch_writes_its_own_keys_only(spark, tmp_path):
    table = merged(spark, tmp_path)
    table.add(frame(spark, [(i, 0, "old") for i in range(5000)]), 0)
    table.add(frame(spark, [(7, 1, "new"), (7, 2, "newer"), (5001, 1, "new")]), 1)
    assert {r.batch: r.rows for r in table.written().collect()} == {0: 5000, 1: 2}
    assert table.read().count() == 5001 and table.lookup(k=7).first().v == "newer"


def test_versions_by_state_equal_those_of_all_changes(spark, tmp_path):
    rng, parts = random.Random(11), 5
    rows = []
    for i in range(300):
        hours = rng.uniform(0, 24 * 10)
        rows.append((rng.randrange(6), DAY + dt.timedelta(hours=round(hours, 1)), rng.choice(["a", "b", None]), min(parts - 1, int((hours + rng.choice([0, 0, 5])) / 240 * parts))))
    changes = spark.createDataFrame(rows, "k long, at timestamp, v string, part int")
    closing = spark.createDataFrame([(-1, at(24 * 99), "end", parts)], changes.schema)
    keys = ["k", "valid_from"]
    table, batches = deltas.MergedTable(spark, f"{tmp_path}/table", keys, deltas.latest(keys, ["ended"]), 100), []

    def run(streams, part):
        made = versions.versions_by_state(streams["c"], ["k"], "at", ["v"], "6 hours")
        deltas.merge_stream(versions.ended_last(made), table, f"{tmp_path}/checkpoint")
        batches.append(part)

    with versions.rocks_state(spark):
        live.replay({"c": changes.unionByName(closing)}, parts + 1, str(tmp_path), run)
    got = rows_of(table.read().where("k >= 0").select("k", "v", "valid_from", "valid_to"))
    folded = changes.groupBy("k", "at").agg(F.max("v").alias("v"))
    want = scd2.build_scd2(folded, ["k"], "at", ["v"]).select("k", "v", "valid_from", "valid_to")
    assert len(batches) == 6 and got == rows_of(want)
    assert table.written().agg(F.sum("rows")).first()[0] <= 2 * len(got) + 1  # no version is written more than twice


def test_a_view_follows_inserts_and_retractions(spark, tmp_path):
    rng, live_rows = random.Random(5), []
    view = views.SumView(spark, str(tmp_path), ["g"], ["x"], ["who"], compact_after=1)
    schema = "g string, x double, who long, sign int"
    for number in range(5):
        new = [(rng.choice(["a", "b", None]), rng.choice([1.5, 2.25, None]), rng.choice([1, 2, 3, None])) for _ in range(30)]
        gone = [live_rows.pop(rng.randrange(len(live_rows))) for _ in range(min(20, len(live_rows)))]
        live_rows += new
        batch = spark.createDataFrame([(*r, 1) for r in new] + [(*r, -1) for r in gone], schema)
        view.apply(batch, number)
        view.apply(batch, number)
    want = {g: (len(rs), sum(r[1] or 0 for r in rs), len({r[2] for r in rs} - {None})) for g in ("a", "b", None) if (rs := [r for r in live_rows if r[0] == g])}
    assert {r.g: (r.lines, r.x, r.who) for r in view.read().collect()} == want
    view.apply(spark.createDataFrame([(*r, -1) for r in live_rows], schema), 5)
    assert view.read().count() == 0
