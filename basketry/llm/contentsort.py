"""Exact duplicates by a content sort: texts are dealt into ranges and sorted there, so equal ones lie side by side.

Sampled splitters deal the rows by the first characters of the folded text, its hash and, for texts with very many
copies, a part number: the same order in every task, of short keys, so what the driver sees of a text is bounded. Each
range is sorted by the full normalised text (Spark's external sort, which spills), and a window compares each row in full
with its neighbour to tell where a group ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, settle

#: Characters of a text that splitters see.
HEAD = 32
#: A text is split into parts once its copies fill the share of a range that is one in so many.
PARTS_A_RANGE = 4
#: No text with fewer copies than this is split.
LEAST_HOT = 32
#: Totals of split texts are broadcast up to so many rows of some 60 bytes, and joined by a shuffle beyond.
BROADCAST_ROWS = 100_000

MADE = ("keep_id", "group_size", "kept", "text_sha256")


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "largest", ranges: int | None = None) -> DataFrame:
    """docs with keep_id, group_size (long), kept and text_sha256 (lowercase hex of the normalised text in UTF-8).

    Texts are equal if they are identical after lower-casing A to Z alone; a null text is the empty one. The row of the
    ``largest`` (or ``smallest``) id of a group stays; ids that are null come last and stay only where a group has no
    other, and of rows that repeat the id that stays, one stays. Every row is given. Columns of the four names are
    replaced, all others are kept whatever they are called. ``ranges`` defaults to the session's shuffle partitions.

    A group with more copies than a quarter of a range's share is dealt over several ranges; its size and the id that
    stays are then counted ahead, one row a task and text. There are at most four such hashes for each range, so their
    list may be broadcast. Parts of one such group are matched by SHA-256.
    """
    spark = docs.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    ident, body = F.col(at[doc_id]), F.coalesce(F.col(at[text]), F.lit(""))
    # lower() folds more than A to Z, so texts that are equal have one hash and head; it is far cheaper than ascii_lower
    hashed = own.withColumns({"head": F.substring(F.lower(body), 1, HEAD), "h": F.xxhash64(F.lower(body))})
    counts = hashed.groupBy("h").agg(F.count("*").alias("copies"))
    limit = max(LEAST_HOT, hashed.count() // (PARTS_A_RANGE * n))
    hot = settle(counts.where(F.col("copies") > limit).select("h", F.ceil(F.col("copies") / limit).cast("int").alias("parts")))
    part = F.coalesce(F.pmod(F.xxhash64(ident), F.col("parts")), F.lit(0))
    dealt = hashed.join(F.broadcast(hot), "h", "left").withColumn("part", part).drop("parts")
    dealt = dealt.repartitionByRange(n, "head", "h", "part").withColumn("norm", ascii_lower(body))
    group = Window.partitionBy("head", "h", "part", "norm").orderBy(ident.desc_nulls_last() if keep == "largest" else ident.asc_nulls_last())
    found = dealt.select(
        *own.columns,
        F.first(ident).over(group).alias("keep_id"),
        F.count("*").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("group_size"),
        F.row_number().over(group).alias("place"),
        F.sha2("norm", 256).alias("text_sha256"),
    )
    if not hot.isEmpty():
        totals = settle(_totals(hashed, hot, ident, body, keep))
        found = found.join(F.broadcast(totals) if totals.count() <= BROADCAST_ROWS else totals, "text_sha256", "left")
        found = found.withColumns({c: F.when(F.col("all").isNotNull(), F.col(f"all.{c}")).otherwise(F.col(c)) for c in ("keep_id", "group_size")})
    found = found.withColumn("kept", (F.col("place") == 1) & F.col("keep_id").eqNullSafe(ident))
    return found.select(*(F.col(at[c]).alias(c) for c in docs.columns if c not in MADE), *MADE)


def _totals(hashed: DataFrame, hot: DataFrame, ident, body, keep: str) -> DataFrame:
    """(text_sha256, all: keep_id and group_size) of the texts under hot hashes, combined in each task before the shuffle."""
    best = F.max if keep == "largest" else F.min
    rows = hashed.join(F.broadcast(hot), "h", "left_semi").select(F.sha2(ascii_lower(body), 256).alias("text_sha256"), ident.alias("id"))
    return rows.groupBy("text_sha256").agg(F.struct(best("id").alias("keep_id"), F.count("*").alias("group_size")).alias("all"))


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "largest") -> DataFrame:
    """docs with one row of each group of equal texts, columns unchanged."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    marked = exact_duplicates(docs.toDF(*names.values()), names[text], names[doc_id], keep)
    return marked.where("kept").select(*(F.col(own).alias(c) for c, own in names.items()))
