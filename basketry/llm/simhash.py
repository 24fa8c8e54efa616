"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at a small Hamming distance through BK-trees.

A BK-tree keeps under each node, by integer distance, the subtree of the fingerprints at that distance; a search
with radius r follows only the edges from d - r to d + r. One tree of all fingerprints would have to pass through
the driver to be broadcast, and a search in it would visit a share of the corpus. So the trees are sharded by the
pigeonhole principle: of ``radius + 2`` blocks of bits, two at least agree in any two fingerprints that differ in
``radius`` bits, so a shard for each pair of blocks and value of their bits meets every link. The fingerprints of
a shard reach its tree by a shuffle; a shard with more than ``tree_nodes`` is split into several trees, and
each fingerprint of the shard is sent to the trees of its own and of lower numbers, so no pair is missed and no
task holds an unbounded tree.

Fingerprints three bits apart miss many texts that share four fifths of their shingles. Where a similarity is asked for,
texts that fingerprints have not linked meet by bands of MinHashes, and each such link is judged on the whole sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bloom import marked, without
from .components import connected_components
from .shared import settle, small_batches

#: Shingles hashed before their bits are added up; bounds the memory that a very long text takes.
_CHUNK = 1 << 15
#: MinHash bands: two texts of similarity 0.8 share one of BANDS bands of ROWS values but for 7 in 100,000 pairs.
ROWS, BANDS = 5, 24
#: Of one block of texts that may be near copies: texts, and shingles in all.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 4 << 20


def _shingles(text: str | None, words: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles, in arrays of at most _CHUNK."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(found) - words + 1) if found else 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for start in range(0, n, _CHUNK):
        stop = min(n, start + _CHUNK)
        yield np.fromiter((digest(join(found[i : i + words]), seed) for i in range(start, stop)), "<u8", stop - start)


def _majority(parts: list[np.ndarray]) -> int:
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in parts:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of a text's word shingles; 0 for a null or blank text.

    A-Z are lower-cased; words are split at space and the control characters 9 to 13. Fewer words than a shingle
    make one shingle.
    """
    return _majority(_shingles(text, words, seed))


_FACTORS = np.random.default_rng(3).integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(parts: list[np.ndarray]) -> list[int]:
    """A signed 64-bit hash of each band of MinHashes of shingle hashes; none without a shingle."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for hashes in parts:
        for i in range(0, len(hashes), 512):
            own = hashes[i : i + 512, None] * _FACTORS
            np.minimum(least, (own ^ (own >> np.uint64(32))).min(axis=0), out=least)
    if not parts:
        return []
    out = np.zeros(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ (out >> np.uint64(29)) ^ row) * np.uint64(0x9E3779B97F4A7C15)
    return out.view(np.int64).tolist()


def shingle_set(text: str | None, words: int = 5, seed: int = 42) -> bytes:
    """The distinct shingle hashes of a text in order, eight bytes each."""
    parts = list(_shingles(text, words, seed))
    return np.unique(np.concatenate(parts)).tobytes() if parts else b""


def fingerprints(text: Column | str, words: int = 3, seed: int = 42) -> Column:
    """``fingerprint`` as a column."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words, seed) for t in texts], dtype="int64")

    return of(text)


class BKTree:
    """Fingerprints (unsigned) under their Hamming distances to their parents."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while d := (value ^ node[0]).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        todo = [self.root] if self.root else []
        while todo:
            own, children = todo.pop()
            d = (value ^ own).bit_count()
            if d <= radius:
                yield own
            if children:
                for edge in range(max(1, d - radius), d + radius + 1):
                    if child := children.get(edge):
                        todo.append(child)


def _forest(nodes: list[int], others: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``nodes``, and from ``others`` to them: (member, smallest member)."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    def link(x: int, y: int) -> None:
        a, b = top(x), top(y)
        if a != b:
            parent[max(a, b)] = min(a, b)

    tree = BKTree()
    for x in nodes:
        for y in tree.within(x, radius):
            link(x, y)
        tree.add(x)
    for x in others:
        for y in tree.within(x, radius):
            link(x, y)
    return [(x, top(x)) for x in list(parent)]


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 2 blocks that make up 64 bits."""
    edges = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def fingerprint_links(distinct: DataFrame, radius: int = 3, tree_nodes: int = 2048) -> DataFrame:
    """``distinct``: a column fp (long) without repeats -> (u, v): a spanning forest of the pairs within ``radius`` bits.

    The forest joins what the full set of links joins; it has at most one row for each fingerprint and tree.
    """
    keys = []
    for (s1, w1), (s2, w2) in combinations(_blocks(radius), 2):
        mask = ((1 << w1) - 1) << s1 | ((1 << w2) - 1) << s2
        keys.append(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    keyed = distinct.where("fp is not null").select("fp", F.posexplode(F.array(*keys)).alias("shard", "bits"))
    sizes = keyed.groupBy("shard", "bits").agg(F.count("*").alias("n")).where("n > 1")
    trees = F.ceil(F.col("n") / tree_nodes)
    dealt = keyed.join(sizes, ["shard", "bits"]).withColumn("own", F.pmod(F.xxhash64("fp", "shard"), trees).cast("int"))
    dealt = dealt.select("shard", "bits", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("tree"))
    dealt = dealt.repartition("shard", "bits", "tree").sortWithinPartitions("shard", "bits", "tree", "fp")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, nodes, others, found = None, [], [], []
        for batch in batches:
            rows = zip(batch["shard"], batch["bits"], batch["tree"], batch["own"], batch["fp"])
            for shard, bits, tree, own, fp in rows:
                if (shard, bits, tree) != key:
                    found += _forest(nodes, others, radius)
                    key, nodes, others = (shard, bits, tree), [], []
                (nodes if own == tree else others).append(int(fp) & 0xFFFFFFFFFFFFFFFF)
            if len(found) > 10_000:
                yield _signed(found)
                found = []
        found += _forest(nodes, others, radius)
        if found:
            yield _signed(found)

    def _signed(pairs: list[tuple[int, int]]) -> pd.DataFrame:
        both = np.array(pairs, dtype=np.uint64).view(np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": both[:, 0], "v": both[:, 1]})

    return dealt.mapInPandas(search, "u long, v long").distinct()


def similar_links(prints: DataFrame, roots: DataFrame, docs: DataFrame, text: str, doc_id: str, words: int, similarity: float, seed: int) -> DataFrame:
    """(u, v): fingerprints of texts that share ``similarity`` of their shingles, as far as ``roots`` do not join them yet.

    ``prints`` has body, key, fp, bands and shingles of each row; ``roots`` root of each fp. Stars over the bands' buckets
    give groups of ids in which all such pairs lie. Only texts of groups with more than one root are read again, and their sets
    go to the group once; a large group is cut in blocks, and each text also meets the blocks before its own.
    """
    texts = prints.groupBy("body").agg(F.min("key").alias("key"), F.min("fp").alias("fp"), F.max("shingles").alias("shingles"), F.min("bands").alias("bands"))
    texts = texts.join(roots, "fp").select("body", "key", "fp", "root", "shingles", "bands")
    banded = texts.select("body", "root", F.posexplode("bands").alias("band", "value"))
    buckets = banded.groupBy("band", "value").agg(F.min("body").alias("first"), F.min("root").alias("low"), F.max("root").alias("high"))
    stars = banded.join(buckets.where("low <> high").select("band", "value", "first"), ["band", "value"])
    groups = connected_components(stars.select(F.col("body").alias("u"), F.col("first").alias("v"))).withColumnRenamed("node", "body").withColumnRenamed("root", "meets")
    known = texts.select("body", "key", "fp", "shingles").join(groups, "body")
    size = known.groupBy("meets").agg(F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum("shingles") / BLOCK_SHINGLES)).alias("blocks"))
    known = settle(known.join(size, "meets").withColumn("own", F.pmod(F.xxhash64("body"), "blocks").cast("int")).select("meets", "own", "key", "fp"))

    @F.pandas_udf("binary")
    def sets(own: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words, seed) for t in own], dtype=object)

    asked = marked(docs.select(row_key(text, doc_id).alias("key"), F.col(text).alias("text")), known, "key").where("maybe")
    held = asked.select("key", sets("text").alias("set")).groupBy("key").agg(F.first("set").alias("set"))
    dealt = known.hint("merge").join(held, "key").select("meets", "own", "fp", "set", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("block"))
    dealt = dealt.repartition("meets", "block").sortWithinPartitions("meets", "block", "own", "fp")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, block = None, _Block(similarity)
        for batch in batches:
            links = []
            for meets, number, own, fp, held in zip(batch["meets"], batch["block"], batch["own"], batch["fp"], batch["set"]):
                if (meets, number) != key:
                    links += block.close()
                    key, block = (meets, number), _Block(similarity)
                shingles = np.frombuffer(held, dtype=np.uint64)
                if own == number:  # the block's own texts come first
                    block.add(fp, shingles)
                else:
                    links += block.close()
                    links += block.met(fp, shingles)
            yield pd.DataFrame(links, columns=["u", "v"], dtype="int64")
        yield pd.DataFrame(block.close(), columns=["u", "v"], dtype="int64")

    return dealt.mapInPandas(compare, "u long, v long").distinct()


class _Block:
    """The texts of a block, found by what they share: all at once by an index of their shingles, not one by one."""

    def __init__(self, similarity: float) -> None:
        self.similarity = similarity
        self.fps: list[int] = []
        self.sets: list[np.ndarray] = []
        self.group = np.zeros(0, dtype=np.int64)
        self.closed = False

    def add(self, fp: int, shingles: np.ndarray) -> None:
        self.fps.append(fp)
        self.sets.append(shingles)

    def close(self) -> list[tuple[int, int]]:
        """Once all are added: a spanning forest of the links among them."""
        if self.closed or not self.fps:
            return []
        self.closed = True
        self.sizes = np.array([len(s) for s in self.sets])
        self.group = np.arange(len(self.fps))
        shingles = np.concatenate(self.sets)
        order = np.argsort(shingles, kind="stable")
        self.shingles, self.holder = shingles[order], np.repeat(np.arange(len(self.fps)), self.sizes)[order]
        links = []
        for i in range(1, len(self.fps)):
            like = self._like(self.sets[i])
            like = like[like < i]
            for j in self._one_of_each(like):
                links.append((self.fps[i], self.fps[j]))
                self.group[self.group == self.group[j]] = self.group[i]
        self.sets.clear()
        return links

    def met(self, fp: int, shingles: np.ndarray) -> list[tuple[int, int]]:
        """Links of a text of another block: to one text of each group that has any like it."""
        return [(fp, self.fps[j]) for j in self._one_of_each(self._like(shingles))] if self.fps else []

    def _one_of_each(self, texts: np.ndarray) -> list[int]:
        return texts[np.unique(self.group[texts], return_index=True)[1]].tolist()

    def _like(self, shingles: np.ndarray) -> np.ndarray:
        """Places of the texts that share ``similarity`` of their union with a set."""
        low, high = np.searchsorted(self.shingles, shingles, "left"), np.searchsorted(self.shingles, shingles, "right")
        count = high - low
        places = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        shared = np.bincount(self.holder[places], minlength=len(self.fps))
        return np.flatnonzero(shared / np.maximum(self.sizes + len(shingles) - shared, 1) >= self.similarity)


def row_key(text: str = "text", doc_id: str = "doc_id") -> Column:
    """The id and a 64-bit hash of the text, as a string: what rows are told apart by."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.xxhash64(text).cast("string"))


def simhash_components(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, radius: int = 3, seed: int = 42, tree_nodes: int = 2048
) -> DataFrame:
    """docs -> (doc_id, fp, component_id), a row for each row of docs.

    component_id is the smallest doc_id of those reachable over fingerprints at most ``radius`` bits apart.
    Equal fingerprints are linked, those of blank and null texts (zero) too. A null doc_id keeps its row and is
    never a component's smallest unless all are null; repeated rows are all returned; other columns are left out.
    """
    small_batches(docs.sparkSession)
    prints, groups = _grouped(docs, text, doc_id, words, radius, seed, tree_nodes)
    return prints.join(groups, "fp", "left").select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, text: str, doc_id: str, words: int, radius: int, seed: int, tree_nodes: int, similarity: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (fp, root, component_id) of each fingerprint; root tells components without ids apart.

    With a similarity, rows have key and what ``similar_links`` needs too.
    """
    own = [F.col(doc_id).alias("doc_id")]
    if similarity is None:
        prints = settle(docs.select(*own, fingerprints(F.col(text), words, seed).alias("fp")))
    else:

        @F.pandas_udf("fp long, bands array<long>, shingles long")
        def signed(texts: pd.Series) -> pd.DataFrame:
            parts = [list(_shingles(t, words, seed)) for t in texts]
            return pd.DataFrame({"fp": [_majority(p) for p in parts], "bands": [bands(p) for p in parts], "shingles": [sum(map(len, p)) for p in parts]})

        rows = docs.select(*own, row_key(text, doc_id).alias("key"), F.xxhash64(text).alias("body"), signed(F.col(text)).alias("of"))
        prints = settle(rows.select("doc_id", "key", "body", "of.fp", "of.bands", "of.shingles"))
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(fingerprint_links(distinct.select("fp"), radius, tree_nodes)).withColumnRenamed("node", "fp")
    found = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    if similarity is not None:
        found = settle(found)
        of = lambda end: found.select(F.col("fp").alias(end), F.col("root").alias(f"root_{end}"))
        more = similar_links(prints, found.select("fp", "root"), docs, text, doc_id, words, similarity, seed).join(of("u"), "u").join(of("v"), "v")
        joined = connected_components(more.select(F.col("root_u").alias("u"), F.col("root_v").alias("v")))
        found = found.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("fp", "least", F.coalesce("top", "root").alias("root"))
    found = settle(found)
    of_root = settle(found.groupBy("root").agg(F.min("least").alias("component_id")))
    return prints, found.join(of_root, "root").select("fp", "root", "component_id")


def hex_fingerprint(fp: Column | str) -> Column:
    """16 lower-case hex digits of a signed fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, radius: int = 3, seed: int = 42, tree_nodes: int = 2048, similarity: float = 0.8, null_ids: bool = False
) -> DataFrame:
    """docs without near copies: of each component, one row with the smallest doc_id stays, with all its columns.

    Texts are linked if their fingerprints differ in ``radius`` bits at most or if they share ``similarity`` of their distinct
    shingles; blank and null texts are one component. Rows that repeat the kept id and text are dropped too. Rows with a null id
    stay with ``null_ids``; without it they go if any of their component has an id, and else all but one of it. The ids and
    texts' hashes alone decide; a text moves only if its row may have to go.
    """
    small_batches(docs.sparkSession)
    prints, groups = _grouped(docs, text, doc_id, words, radius, seed, tree_nodes, similarity)
    if null_ids:
        prints = prints.where("doc_id is not null")
    groups = settle(groups.select("fp", "root"))
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    # written, so that the joins below are of two plain tables, which Spark may split where a group is hot
    best = settle(first.join(groups, "fp").groupBy("root").agg(F.min("first").alias("best")).select("root", F.col("best.key").alias("best")))
    rows = settle(prints.groupBy("fp", "key").agg(F.count("*").alias("n")).join(groups, "fp").join(best, "root"))
    listed = rows.withColumn("keep", F.col("key") == F.col("best")).where("not keep or n > 1").select("key", "keep")
    key = row_key(text, doc_id)
    return without(docs, F.when(F.col(doc_id).isNotNull(), key) if null_ids else key, listed, once=True)
