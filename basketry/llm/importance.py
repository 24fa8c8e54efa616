"""Importance resampling towards a target: hashed n-gram weights of whole texts, and a draw by perturbed scores.

Two histograms of hashed features, of all documents and of the target texts, give each bucket a gain; a document's weight
is the sum over its features, looked up in an array. The draw takes the highest sums of weight and Gumbel noise: the
cutoff is found by counting above ever closer thresholds, and only what is drawn is put in order.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle, small_batches, with_fields

#: Hash buckets of the features; the array of gains is of this size at any input.
BUCKETS = 10_000
#: Drawn: so many of a hundred documents with at least MIN_WORDS words.
PERCENT, MIN_WORDS = 5, 20
SEED = "42"
#: Thresholds that one count job tries.
PIVOTS = 15
#: Bytes of text hashed at once; a longer text is hashed alone.
_PIECE = 1 << 22
#: Longer words than this are hashed one by one.
_LONG = 48


def _step(crc: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    """The CRC register after one more byte."""
    return _TABLE[(crc ^ byte) & 255] ^ (crc >> 8)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    # what a register byte becomes after 2^k zero bytes, by its place in the register
    after = [np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]]
    after[0] = table[after[0] & 255] ^ (after[0] >> 8)
    for _ in range(31):
        last = after[-1]
        after.append(last[0][last & 255] ^ last[1][last >> 8 & 255] ^ last[2][last >> 16 & 255] ^ last[3][last >> 24])
    return table, np.stack(after)


_TABLE, _AFTER = _tables()
_BYTES = np.arange(256, dtype=np.uint8)
#: A to Z in lower case; word bytes are digits, a to z and all of other scripts.
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)


def _joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of texts put together, from the CRCs of both parts and the second's length in bytes."""
    for k in range(int(length.max(initial=0)).bit_length()):
        t, held = _AFTER[k], (length >> k & 1).astype(bool)
        c = first[held]
        first = first.copy()
        first[held] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
    return first ^ second


def _words(low: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words of lower-cased bytes begin, and their lengths; no word goes over a bound."""
    inside = np.zeros(len(low) + 2, dtype=bool)
    inside[1:-1] = _WORD[low]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    at = bounds[(bounds > 0) & (bounds < len(low))]
    first[at] = inside[at + 1]
    last[at - 1] = inside[at]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1 - start


def _crcs(low: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC of each word: all words take their k-th byte together."""
    order = np.argsort(-length, kind="stable")
    begins, lengths = start[order], length[order]
    register = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(min(_LONG, int(lengths[0]) if len(lengths) else 0)):
        n = np.searchsorted(-lengths, -k)
        register[:n] = _step(register[:n], low[begins[:n] + k])
    for i in range(np.searchsorted(-lengths, -_LONG)):
        register[i] = zlib.crc32(low[begins[i] : begins[i] + lengths[i]]) ^ 0xFFFFFFFF
    out = np.empty_like(register)
    out[order] = ~register
    return out


def _spaced(crc: np.ndarray) -> np.ndarray:
    return ~_step(~crc, 32)


def _features(data: np.ndarray, bounds: np.ndarray, buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the runs of one, two and three words, each by the word it begins at and -1 where the text is too short; words before each bound."""
    low = _LOWER[data]
    start, length = _words(low, bounds)
    words = np.searchsorted(start, bounds)
    runs = [_crcs(low, start, length)]
    left = np.repeat(words[1:], np.diff(words)) - np.arange(len(start))  # words from here to the end of the text
    for n in (2, 3):
        more = max(len(start) - n + 1, 0)
        runs.append(_joined(_spaced(runs[-1][:more]), runs[0][n - 1 :][:more], length[n - 1 :][:more]))
    out = []
    for n, crc in enumerate(runs, 1):
        bucket = np.full(len(start), -1, dtype=np.int64)
        bucket[: len(crc)] = crc % buckets
        out.append(np.where(left >= n, bucket, -1))
    return out, words


def _pieces(texts: pa.Array):
    """(bytes, bounds) of consecutive texts, whole texts of some megabytes together; nulls are empty."""
    texts = texts.fill_null("")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return
    offsets = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _PIECE, "right")) - 1)
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often features of each bucket come in all texts; a task gives one row a bucket. Null texts have none."""
    small_batches(docs.sparkSession)

    def counted(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for data, bounds in _pieces(batch.column(0)):
                for bucket in _features(data, bounds, buckets)[0]:
                    total += np.bincount(bucket[bucket >= 0], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(seen, pa.int32()), "n": pa.array(total[seen], pa.int64())})

    return docs.select(text).mapInArrow(counted, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def learn_gains(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln) of each bucket's share in ``target`` over its share in ``docs``, one added to each bucket's count.

    Both are counted over all rows; only the counts of the buckets, of fixed number, come to the driver. Empty tables have
    counts of zero.
    """
    sides = []
    for rows in (docs, target):
        held = {r["bucket"]: r["n"] for r in bucket_counts(rows, text, buckets).collect()}
        sides.append([held.get(b, 0) for b in range(buckets)])
    total_s, total_t = (float(sum(side) + buckets) for side in sides)
    return [math.floor(1000 * math.log((t + 1.0) * total_s / ((s + 1.0) * total_t))) for s, t in zip(*sides)]


def with_weights(docs: DataFrame, gains: list[int], text: str = "text") -> DataFrame:
    """docs with n_words, n_features and weight (long), the sum of the gains of all features.

    A null or empty text has no features and weight 0. Every row is given; columns of the three names are replaced. A task
    holds some 30 times the longest text.
    """
    small_batches(docs.sparkSession)
    table = np.array([*gains, 0], dtype=np.int64)  # the last, at -1, is for what is no feature

    @F.arrow_udf("struct<n_words bigint, n_features bigint, weight bigint>")
    def weighed(texts: pa.Array) -> pa.Array:
        words, features, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for data, bounds in _pieces(texts):
            found, before = _features(data, bounds, len(gains))
            sums = np.concatenate([[0], np.cumsum(sum(table[b] for b in found))])
            n = np.diff(before)
            words.append(n)
            features.append(n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0))
            weights.append(sums[before[1:]] - sums[before[:-1]])
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (words, features, weights)], ["n_words", "n_features", "weight"])

    return with_fields(docs, weighed(F.col(text)), ["n_words", "n_features", "weight"])


def with_scores(weighed: DataFrame, doc_id: str = "doc_id", seed: str = SEED) -> DataFrame:
    """weighed with score: weight and 1000 times Gumbel noise from a hash of the id, in whole numbers. A null id has a null score."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + noise)


def _least(rows: DataFrame, value: str, k: int) -> int | None:
    """The smallest v with at least k rows of value <= v, by count jobs that each leave a sixteenth of the span; None if k is 0."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if k < 1 or low is None:
        return None
    while low < high:
        pivots = sorted({low + (high - low) * i // (PIVOTS + 1) for i in range(1, PIVOTS + 1)})
        counts = rows.agg(*(F.count_if(F.col(value) <= F.lit(p)) for p in pivots)).first()
        enough = [p for p, n in zip(pivots, counts) if n >= k]
        below = [p for p, n in zip(pivots, counts) if n < k]
        low, high = (below[-1] + 1 if below else low), (enough[0] if enough else high)
    return low


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, doc_id: str = "doc_id") -> DataFrame:
    """scored with rank: 1, 2, 3... by falling score, ties to the smaller id; null for what is not drawn.

    floor(percent/100) of the rows with at least ``min_words`` words and an id are drawn, none where that is less than one.
    ``scored`` is computed once. Ids are whole numbers. Rows that repeat id and score are ordered anyhow among themselves;
    the draw may end between them.
    """
    scored = settle(scored.drop("rank").withColumn("_may", (F.col("n_words") >= min_words) & F.col("score").isNotNull() & F.col(doc_id).isNotNull()))
    may = scored.where("_may").select((-F.col("score")).alias("low"), F.col(doc_id).alias("id"))
    k = may.count() * percent // 100
    cut = _least(may, "low", k)
    if cut is None:
        return scored.drop("_may").withColumn("rank", F.lit(None).cast("long"))
    last = _least(may.where(F.col("low") == cut), "id", k - may.where(F.col("low") < cut).count())
    over = F.col("_may") & ((F.col("score") > -cut) | ((F.col("score") == -cut) & (F.col(doc_id) <= last)))
    over = F.coalesce(over, F.lit(False))
    order = [F.col("score").desc(), F.col(doc_id)]
    # ids that Spark counts up within a partition are places in the sorted range; the ranges before are added
    drawn = settle(scored.where(over).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = drawn.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("n")).collect()  # a row for each range
    before, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["_range"]):
        before[r["_range"]], total = total, total + r["n"]
    starts = scored.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_range bigint, _before bigint")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    ranked = drawn.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(starts), "_range")
    ranked = ranked.withColumn("rank", F.when(place <= k, place)).select(*scored.columns, "rank")
    return ranked.unionByName(scored.where(~over).withColumn("rank", F.lit(None).cast("long"))).drop("_may")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id", seed: str = SEED) -> DataFrame:
    """The rows of docs that are drawn towards ``target``, with weight, score and rank; columns of those names are replaced.

    Texts are read twice, and written once with the scores.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    gains = learn_gains(docs, target, text)
    scored = with_scores(with_weights(docs.toDF(*own.values()), gains, own[text]), own[doc_id], seed)
    drawn = draw(scored, percent, min_words, own[doc_id]).where("rank is not null")
    made = ["weight", "score", "rank"]
    return drawn.select(*(F.col(own[c]).alias(c) for c in docs.columns if c not in made), *made)
