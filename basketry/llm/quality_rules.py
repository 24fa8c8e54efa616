"""Quality rules in DataFrame functions only: counts of words, marks, repeats, and a likelihood ratio of hashed n-grams.

The ratio compares two multinomials over hashed word n-grams: one of trusted documents, one of the whole raw corpus.
A document's score is its mean log ratio, so its length has no say, and one threshold judges every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import marked
from .shared import settle

#: Hash buckets of the n-grams; the table of their log ratios is of this size at any input.
BUCKETS = 1 << 14
#: N-gram lengths in words.
SIZES = (1, 2)
#: Pseudo-counts spread over the buckets, in each multinomial.
SMOOTHING = 0.5
#: A document is kept from this mean log ratio on.
THRESHOLD = -0.04

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")

_SPACE = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column | str) -> Column:
    """Words between runs of space and the control characters 9 to 13; none in a null text."""
    text = F.btrim(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, _SPACE))


def _bucket(*words: Column) -> Column:
    """Hash bucket of an n-gram; another range of seeds for each length."""
    return F.pmod(F.xxhash64(F.lit(len(words)), *words), F.lit(BUCKETS)).cast("int")


def _from(words: Column, k: int, n: int) -> Column:
    """The words that begin as the k-th of windows of n words, in order."""
    return F.slice(words, k, F.greatest(F.size(words) - (n - 1), F.lit(0)))


def _counts(docs: DataFrame) -> DataFrame:
    """(bucket, raw, maybe): n-grams of all texts, and of those whose ``maybe`` is true."""
    words = docs.select("maybe", words_of("text").alias("words"))
    pairs = F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, F.size("words")).alias("b"))
    each = words.where(F.size("words") > 0).select("maybe", F.inline(pairs).alias("a", "b"))
    grams = each.select("maybe", F.explode(F.array(_bucket(F.col("a")), F.when(F.col("b").isNotNull(), _bucket(F.col("a"), F.col("b"))))).alias("bucket")).where("bucket is not null")
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("maybe").alias("maybe"))


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id", blocks: int | None = None) -> list[float]:
    """ln of trusted over raw probability of each bucket.

    ``trusted`` has the ids of trusted documents; null ids trust nothing, and null texts have no words. Both multinomials are counted
    over all documents they stand for, and texts stay where they are: a filter (of ``blocks``, else of a size for them) tells the trusted, and what it tells
    wrongly is counted apart. Only the bucket totals, of fixed number, come to the driver.
    """
    ids = settle(trusted.select(F.col(doc_id).alias("id")).where("id is not null").distinct())
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    counts = {row["bucket"]: (row["raw"], row["maybe"]) for row in _counts(marked(own, ids, "id", blocks)).collect()}
    # ids alone are shuffled to find whom the filter let through wrongly; their texts are counted again to be taken off
    wrong = settle(marked(own.select("id"), ids, "id", blocks).where("maybe").select("id").distinct().join(ids.hint("merge"), "id", "left_anti"))
    wrongly = marked(own, wrong, "id", blocks).where("maybe").join(wrong.hint("merge"), "id", "left_semi")
    off = {row["bucket"]: row["maybe"] for row in _counts(wrongly).collect()}
    raw, target = [SMOOTHING] * BUCKETS, [SMOOTHING] * BUCKETS
    for bucket, (all_of_it, maybe) in counts.items():
        raw[bucket] += all_of_it
        target[bucket] += maybe - off.get(bucket, 0)
    # doubles of 5 digits make a short literal; the same for every document
    sums = sum(raw), sum(target)
    from math import log

    return [round(log(t / sums[1]) - log(r / sums[0]), 4) for r, t in zip(raw, target)]


def _computed(frame: DataFrame, names: list[str]) -> DataFrame:
    """The frame with ``names`` handed on as values: a later filter on them is not pushed into their arrays' making,
    where it would be worked out again for each word."""
    rest = [c for c in frame.columns if c not in names]
    return frame.select(*rest, F.inline(F.array(F.struct(*names))))


def _repeated(frame: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in windows of three that the text holds twice or more."""
    n = F.size("_words")
    window = F.transform(F.arrays_zip(*(_from(F.col("_words"), k, 3).alias(f"w{k}") for k in (1, 2, 3))), lambda w: F.xxhash64(w))
    frame = frame.withColumn("_windows", F.when(n >= 4, window))
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    frame = frame.withColumn("_placed", F.when(some, placed))

    def again(i: Column) -> Column:
        own = F.get("_placed", i)["h"]
        return F.coalesce(own == F.get("_placed", i - 1)["h"], F.lit(False)) | F.coalesce(own == F.get("_placed", i + 1)["h"], F.lit(False))

    starts = F.transform(F.filter(F.sequence(F.lit(0), F.size("_placed") - 1), again), lambda i: F.get("_placed", i)["i"])
    frame = frame.withColumn("_starts", F.when(F.col("_placed").isNotNull(), F.sort_array(starts)))
    covered = F.transform("_starts", lambda s, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - s, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return frame.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long")))


def _ruled(docs: DataFrame, text: str) -> DataFrame:
    """(_row, _words, BASE...): internal columns only, so no column of docs clashes with them."""
    body = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text")).withColumns({"_words": words_of("_text"), "_lines": lines})
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    out = _repeated(out).drop("_text", "_lines", "_windows", "_placed", "_starts")
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return _computed(out, list(BASE))


def _back(docs: DataFrame, ruled: DataFrame, names: list[str]) -> DataFrame:
    return ruled.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns if c not in names), *names)


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    A null text counts as an empty one: no words, so it fails. Windows are compared by 64-bit hash. Every row is given, repeats
    too; columns of the six names are replaced.
    """
    return _back(docs, _ruled(docs, text), list(BASE))


def judge(docs: DataFrame, ratios: list[float], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the columns of ``base_rules``, llr (mean log ratio of the n-grams; null without words) and kept.

    Every row is judged, repeats too; a null or empty text is not kept. Columns of the eight names are replaced, others stay as
    they are.
    """
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    out, words = _ruled(docs, text), F.col("_words")
    add = lambda total, bucket: total + F.get(table, bucket)
    single = F.aggregate(words, F.lit(0.0), lambda total, w: add(total, _bucket(w)))
    total = F.aggregate(F.zip_with(_from(words, 1, 2), _from(words, 2, 2), lambda a, b: _bucket(a, b)), single, add)
    grams = sum((F.greatest(F.lit(0), F.size("_words") - (n - 1)) for n in SIZES), F.lit(0))
    out = out.withColumn("llr", F.try_divide(total, grams)).drop("_words")
    out = _computed(out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False))), ["llr", "kept"])
    return _back(docs, out, [*BASE, "llr", "kept"])
