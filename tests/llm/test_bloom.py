import pytest
from basketry.llm import bloom
from pyspark.sql import functions as F


def test_size_follows_the_list():
    assert bloom.blocks_for(0) == 1 and bloom.blocks_for(40) == 1 and bloom.blocks_for(1 << 40) == bloom.MOST_BLOCKS
    for keys in (1000, 3_000_000, 40_000_000):
        assert bloom.blocks_for(keys) * 512 >= bloom.KEY_BITS * keys


@pytest.mark.parametrize("keys", [100, 400_000])
def test_few_strangers_pass_at_any_size(spark, keys):
    listed = spark.range(keys).select((F.col("id") * 7).alias("key"))
    rows = spark.range(20_000).select((F.col("id") * 7 + 3).alias("key"), F.lit("x").alias("own"))
    got = bloom.marked(rows, listed, "key")
    assert got.where("maybe").count() < 0.01 * 20_000 and got.columns == ["key", "own", "maybe"]
    assert bloom.marked(listed, listed, "key").where("not maybe").count() == 0


def test_a_list_beyond_the_bound_loses_no_key(spark, monkeypatch):
    """A list of ten times what the filter has bits for: more rows pass, and the exact join gives the same."""
    monkeypatch.setattr(bloom, "MOST_BLOCKS", 8)
    listed = spark.range(4000).select(F.col("id").alias("key"))
    rows = spark.range(5000).select((F.col("id") + 2000).alias("key")).unionByName(spark.createDataFrame([(None,)], "key long"))
    assert sorted(r.key or -1 for r in bloom.without(rows, F.col("key"), listed).collect()) == [-1, *range(4000, 7000)]
    assert bloom.without(rows, F.col("key"), listed.limit(0)).count() == 5001
