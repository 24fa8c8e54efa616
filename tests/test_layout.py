"""Layouts, heavy hitters, sketches and variants on small frames."""

import random
import uuid

from basketry.operators import layout, sketches, skew
from basketry.sources import variant
from pyspark.sql import functions as F


def test_interleaved_key_is_its_bits_by_turns(spark):
    rows = [(random.Random(i).randrange(256), random.Random(-i).randrange(256)) for i in range(1, 200)]
    bits = lambda a, b: int("".join(x + y for x, y in zip(f"{a:08b}", f"{b:08b}")), 2)
    got = spark.createDataFrame(rows, "a int, b int").select("a", "b", layout.z_key([F.col("a"), F.col("b")]).alias("z")).collect()
    assert all(r.z == bits(r.a, r.b) for r in got)


def test_parts_are_found_by_halves(spark):
    edges = [3, 7, 7.5, 20]
    got = spark.createDataFrame([(float(x) / 2,) for x in range(-4, 50)] + [(None,)], "x double").select("x", layout.part_of(F.col("x"), edges).alias("p")).collect()
    assert all(r.p == (0 if r.x is None else sum(e < r.x for e in edges)) for r in got)


def test_second_key_lies_in_few_files(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") % 200).alias("day"), F.pmod(F.xxhash64("id"), F.lit(100)).alias("store"), "id").withColumn("day", F.when(F.col("id") % 50 == 3, None).otherwise(F.col("day")))
    layout.write_z_ordered(rows, f"{tmp_path}/z", ["day", "store"], 16)
    layout.write_file_index(spark, f"{tmp_path}/z", ["day", "store"], f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    span = {"store": (10, 15)}
    want = {r.id for r in rows.where("store between 10 and 15").collect()}
    assert {r.id for r in layout.read_range(spark, f"{tmp_path}/z", index, span).collect()} == want
    assert len(layout.files_for(index, span)) <= 12 and layout.read_range(spark, f"{tmp_path}/z", index, {"store": (1000, 1001)}).count() == 0


def test_tables_bucketed_alike_join_without_a_shuffle(spark, tmp_path):
    run = uuid.uuid4().hex
    frames = [layout.write_bucketed(spark.range(1000).select((F.col("id") % 37).alias("a"), (F.col("id") % 11).alias("b"), F.col("id").alias(n)), f"{n}_{run}", f"{tmp_path}/{n}", ["a", "b"], 4) for n in ("x", "y")]
    joined = frames[0].join(frames[1].hint("merge"), ["a", "b"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == sum(1 for i in range(1000) for j in range(1000) if i % 37 == j % 37 and i % 11 == j % 11)


def test_only_hot_keys_are_salted(spark):
    left = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).alias("k"), F.col("id").alias("x"))
    right = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    hot = skew.hot_keys(left, ["k"])
    assert hot == [right.where("k = 7").select(F.xxhash64("k")).first()[0]]
    assert skew.hot_keys(right, ["k"]) == [] and skew.hot_keys(right.limit(0), ["k"]) == []
    for how in ("inner", "left"):
        want = sorted(map(tuple, left.join(right.where("k <> 5"), "k", how).collect()), key=str)
        assert sorted(map(tuple, skew.hot_salted_join(left, right.where("k <> 5"), ["k"], ["x"], 8, hot, how).collect()), key=str) == want
    same = [sorted(map(tuple, f.collect())) for f in (skew.plain_agg(left, "k", "x", "x"), skew.hot_salted_agg(left, "k", "x", "x", 8, hot))]
    assert same[0] == same[1]


def test_sketches_roll_up_within_their_error(spark):
    rows = spark.range(200_000).select((F.col("id") % 12).alias("day"), F.pmod(F.xxhash64("id"), F.lit(30_000)).alias("user"))
    stored = sketches.distinct_sketches(rows, ["day"], "user")
    exact = rows.agg(F.countDistinct("user").alias("users"))
    got = sketches.rolled_up(stored, []).crossJoin(exact).select("rows", sketches.within_error("estimate", "users").alias("ok"), "estimate", "users").first()
    assert got.rows == 200_000 and got.ok and got.estimate != got.users  # an estimate, and near
    with_nulls = spark.createDataFrame([(1, None), (1, 5), (2, None)], "day int, user long")
    assert {r.day: r.estimate for r in sketches.rolled_up(sketches.distinct_sketches(with_nulls, ["day"], "user"), ["day"]).collect()} == {1: 1, 2: 0}


def test_drift_is_told_from_sketches(spark):
    from basketry.plans import features

    base = spark.range(30_000).select((F.pmod(F.xxhash64("id"), F.lit(10_000)) / 100).alias("x"))
    for shift in (0, 10, 30):
        now = base.select((F.col("x") + shift).alias("x"))
        near = sketches.sketch_stability(*(sketches.quantile_sketches(f, [], "x") for f in (base, now))).first().psi
        assert abs(near - features.population_stability(base, now, "x").first().psi) <= 0.05 * (1 + shift)


def test_variants_lose_nothing(spark):
    lines = ['{"a": 1, "b": {"c": "x", "d": [1, 2]}, "e": null}', '{"a": "one", "b": 5}', "{broken", "[1]", None, "", '{"a": 2.5, "new": {"deep": {"er": true}}}']
    rows = variant.parsed(spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string"))
    got = {r.i: r for r in variant.typed(rows, {"a": "bigint", "b.c": "string", "b.d[1]": "int", "e": "string"}).withColumn("all", F.to_json("_variant")).collect()}
    assert (got[0].a, got[0].b_c, got[0].b_d_1, got[0].e, got[0]._rescued) == (1, "x", 2, None, None)
    assert got[1].a is None and got[1]._rescued == {"a": '"one"'} and '"b":5' in got[1]["all"]
    assert got[2]._broken == "{broken" and got[5]._broken == "" and got[4]._broken is None
    assert '"er":true' in got[6]["all"]
    kinds = {r.field: (r.type, r.rows) for r in variant.fields(rows).collect()}
    assert kinds["new"] == ("OBJECT<deep: OBJECT<er: BOOLEAN>>", 1) and kinds["a"][0] == "VARIANT" and kinds["b"] == ("VARIANT", 2)
