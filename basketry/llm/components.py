"""Connected components of a graph given as a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle


def connected_components(links: DataFrame) -> DataFrame:
    """(u, v) long pairs -> (node, root): root is the smallest node reachable; one row for each linked node.

    Each round points every node at the smallest node among its neighbours, so the number of rounds grows with
    the logarithm of the longest path. Stars are made with minima that combine before the shuffle and with joins
    that Spark may split, never with a list of all the neighbours of a node. Nulls and self-links are left out.
    """
    now = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = settle(now.where("u is not null and v is not null and u <> v").distinct())
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
