"""A blocked Bloom filter as a table: blocks of eight 64-bit words, a key setting one bit of each word.

The filter is sized by its list, up to a bound of 64 MB, so it may be broadcast; a longer list makes it let more through, in
the end all, and what it lets through is shuffled. What it lets through always meets the list itself in an exact join, so its
false positives change no result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key of the list, and blocks of 512 bits at most: 64 MB, at which some 44 million keys still have their bits.
KEY_BITS, MOST_BLOCKS = 12, 1 << 20
_LANES = 8


def blocks_for(keys: int) -> int:
    """Blocks of the filter of a list of so many keys: a power of two, within the bound."""
    return min(MOST_BLOCKS, 1 << max(0, (keys * KEY_BITS - 1) // (64 * _LANES)).bit_length())


def _probe(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """(block, word masks): the bit of each of eight words, from 6 bits of a second hash each."""
    bits = F.xxhash64(F.lit(1), key)
    places = (F.shiftright(bits, 6 * lane).bitwiseAND(F.lit(63)).cast("int") for lane in range(_LANES))
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places]


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w7) of a column of keys: at most ``blocks`` rows, combined before the shuffle. Nulls set nothing."""
    block, masks = _probe(F.col(key), blocks)
    placed = listed.where(F.col(key).isNotNull()).select(block.alias("block"), *(m.alias(f"w{k}") for k, m in enumerate(masks)))
    return placed.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(_LANES)))


def marked(rows: DataFrame, listed: DataFrame, key: str, blocks: int | None = None) -> DataFrame:
    """rows and a boolean ``maybe``: false if rows[key] is surely not in listed[key], and for a null key.

    ``rows`` must not have columns named maybe, block or w0 to w7. Without ``blocks`` the list is counted, so it should be settled.
    """
    blocks = blocks or blocks_for(listed.count())
    block, masks = _probe(F.col(key), blocks)
    asked = rows.withColumn("block", block).join(F.broadcast(bloom_blocks(listed, key, blocks)), "block", "left")
    held = reduce(lambda a, b: a & b, (F.col(f"w{k}").bitwiseAND(m) != 0 for k, m in enumerate(masks)))
    return asked.select(*rows.columns, F.coalesce(held & F.col(key).isNotNull(), F.lit(False)).alias("maybe"))


def without(rows: DataFrame, key: Column, listed: DataFrame, once: bool = False) -> DataFrame:
    """rows whose key is not in ``listed`` (one column, ``key``), all columns kept; rows of a null key stay.

    Rows that the filter rules out stay where they are; only the others are shuffled to the list.
    ``listed`` may name keys twice. With ``once``, ``listed`` has a second column ``keep``: of rows with a key listed as
    true one stays, the first by its JSON; keys that come more than once in ``rows`` must all be listed then.
    """
    held = marked(rows.select(F.struct("*").alias("row"), key.alias("key")), listed, "key")
    clear, rest = held.where("not maybe").select("row"), held.where("maybe").select("row", "key")
    if once:
        rest, listed = rest.groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row")), listed.where("not keep").select("key")
    rest = rest.join(listed.hint("merge"), "key", "left_anti").select("row")
    return clear.unionByName(rest).select("row.*")
