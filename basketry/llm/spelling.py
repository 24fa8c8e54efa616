"""Spelling variants: words at edit distance one, found by pivotal grams, grouped under their most frequent forms.

Bigrams are ordered by how rare they are among all words; a word's prefix is its three rarest. One edit spoils at most
one of two disjoint bigrams, so of two near words the one whose prefix ends earlier in the order has a pivot that the
other holds too, in its own prefix. Left or right of an unspoilt pivot nothing is edited, so that side is
part of the key: the pivot's position is bound exactly, from the front or from the back.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, settle, small_batches

#: Words are of so many code points at least, and come at least so often.
MIN_LENGTH, MIN_COUNT = 7, 2
#: One run in so many of a document is misspelt, by the rule of ``misspelt``.
SPOIL = 31
#: A word's form is at least so many times as frequent.
RATIO = 10
#: Letters from an end of a word from which on they are a key by themselves; fewer are joined by half of the rest.
FLANK = 7
#: Code points up to which a pair is judged by Spark's edit distance.
PLAIN = 64
#: Letters of a run: A to Z and the second half of Latin-1.
_LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Bigrams of a prefix: those that one edit can spoil, two, and one more.
PREFIX = 3


def misspelt(run: Column, doc_id: Column, one_in: int = SPOIL) -> Column:
    """The run, or without one code point where the CRC of ``<doc_id>:<run>`` is a multiple of ``one_in``; a null id spoils nothing."""
    h, at = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run)), F.length(run)
    cut = (h % at).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substr(run, F.lit(1), cut), F.substr(run, cut + 2))).otherwise(run)


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", one_in: int = SPOIL, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of letters of whole texts, A to Z lower-cased, ``misspelt``; null texts have none, repeated rows count again.

    Counts are combined in each task before the shuffle.
    """
    pattern = F.lit(f"[{_LETTERS}]{{{min_length},}}")  # a shorter run gives no word of that length
    runs = docs.select(F.col(doc_id).alias("id"), F.explode(F.regexp_extract_all(F.col(text), pattern, F.lit(0))).alias("run"))
    low = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(ascii_lower("run"))
    words = runs.select("id", low.alias("run")).select(misspelt(F.col("run"), F.col("id"), one_in).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def gram_order(words: DataFrame) -> dict[str, int]:
    """The place of each bigram from the rarest on, by the words that hold it; as many as pairs of letters at most."""
    grams = words.select(F.explode(F.regexp_extract_all("word", F.lit("(?=(..))"), F.lit(1))).alias("gram"))
    held = grams.groupBy("gram").agg(F.count("*").alias("n")).collect()
    return {r["gram"]: i for i, r in enumerate(sorted(held, key=lambda r: (r["n"], r["gram"])))}


def prefix_of(word: str, order: dict[str, int]) -> tuple[list[tuple[int, int]], list[int]]:
    """The three rarest bigrams, as (position, place in the order), and the positions of all that the word is found by.

    Of bigrams alike the first ones count as rarer. One edit puts at most two more of a kind before a given one, so the
    word is found by the next two of the last kind too. The word has three bigrams at least.
    """
    ranked = sorted((order[word[i : i + 2]], i) for i in range(len(word) - 1))
    last, kind = ranked[PREFIX - 1][0], 0
    found = []
    for place, i in ranked:
        kind += place == last
        if place > last or kind > PREFIX + 2:
            break
        found.append(i)
    return sorted((i, place) for place, i in ranked[:PREFIX]), found


def pivots_of(prefix: list[tuple[int, int]]) -> tuple[int, int]:
    """Positions of the two disjoint bigrams of least total place: for each second one, the best that ends before it."""
    best, found, ended = None, None, 0
    for i, place in prefix:
        while prefix[ended][0] <= i - 2:  # a bigram that ends before i, met in order of position
            best = min(best or prefix[ended][::-1], prefix[ended][::-1])
            ended += 1
        if best is not None and (found is None or best[0] + place < found[0]):
            found = (best[0] + place, best[1], i)
    return found[1:]


def tokens(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """(word, n) -> (word, n, last, at, pivot): the bigrams that a word is found by, at most seven, two of them pivots.

    ``last`` is the place in the order where the word's prefix ends, ``at`` the bigram's position.
    """
    small_batches(words.sparkSession)

    def made(batches):
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                prefix, found = prefix_of(word, order)
                pivots = pivots_of(prefix)
                rows.extend((word, n, max(p for _, p in prefix), i, i in pivots) for i in found)
            columns = zip(*rows) if rows else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["word", "n", "last", "at", "pivot"])

    return words.select("word", "n").mapInArrow(made, "word string, n bigint, last int, at int, pivot boolean")


def _keys(word: Column, at: Column, asks: bool) -> Column:
    """Hashes that a bigram of a word asks for, or is found by: of what one edit elsewhere leaves alone, and of the found word's length.

    An edit lies on one side of an unspoilt bigram, so the text from the other end up to and with it is left. Where that is
    shorter than FLANK, the rest of the word that asks is halved: the edit is in the second half, and the first is left too, or
    it is in the first, and the second is left, moved by as much as the lengths differ.
    """
    keys, length = [], F.length(word)
    for side, text, front in ((0, word, at + 2), (1, F.reverse(word), length - at)):
        for d in (-1, 0, 1):  # the length of the word that is found, less that of the one that asks
            asking, found = (length, length + d) if asks else (length - d, length)
            half = F.when(front < FLANK, F.greatest(front, F.shiftright(asking + front + 1, 1))).otherwise(front)
            begins, rest = F.substr(text, F.lit(1), half), F.substr(text, half + 1 + (0 if asks else d))
            keys.append(F.xxhash64(F.lit(side), front, found, begins))
            keys.append(F.when(front < FLANK, F.xxhash64(F.lit(side + 2), F.lit(d), front, found, F.substr(text, F.lit(1), front), rest)))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def one_edit(a: str, b: str) -> Column:
    """Whether one inserted, deleted or replaced code point sets two columns apart; their lengths differ by one at most.

    Spark's edit distance takes time with the square of the length, so long words are cut where they first differ instead.
    """
    longer, shorter = (F.when((F.length(a) >= F.length(b)) == first, F.col(a)).otherwise(F.col(b)) for first in (True, False))
    differ = F.zip_with(F.split(longer, ""), F.split(shorter, ""), lambda x, y: ~x.eqNullSafe(y))
    k = F.array_position(differ, True).cast("int")
    without = lambda w: F.concat(F.substr(w, F.lit(1), k - 1), F.substr(w, k + 1))
    cut = without(longer) == F.when(F.length(a) == F.length(b), without(shorter)).otherwise(shorter)
    return F.when(F.length(a) <= PLAIN, F.levenshtein(a, b, 1) == 1).otherwise((k > 0) & cut)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each two words that one inserted, deleted or replaced code point sets apart, both ways round.

    ``words`` has distinct words of four code points at least, with their counts.
    """
    index = settle(tokens(words, gram_order(words)))
    asking, held = (
        rows.select(*(F.col(c).alias(f"{name}_{c}") for c in ("word", "n", "last")), F.explode(_keys(F.col("word"), F.col("at"), asks)).alias("key"))
        for name, rows, asks in (("a", index.where("pivot"), True), ("b", index, False))
    )
    met = asking.join(held, "key").where("a_last <= b_last and a_word <> b_word")
    found = met.where(one_edit("a_word", "b_word"))
    low = F.col("a_word") < F.col("b_word")
    one = found.select(*(F.when(low, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("a_word", "b_word", "word"), ("a_n", "b_n", "n"), ("b_word", "a_word", "near"), ("b_n", "a_n", "near_n")))).distinct()
    both = F.inline(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return one.select(both)


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n) -> (word, form, root, n, n_near, form_n).

    ``form`` is the near word of largest count, of ties the first in code-point order, if it is ``ratio`` times as frequent
    as the word; ``root`` is where forms lead from the word, itself without one. Words without a near word have n_near 0.
    ``words`` is computed once.
    """
    words = settle(words)
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("low"), F.col("near").alias("form"))).alias("best"))
    out = words.join(near, "word", "left")
    has = -F.col("best.low") >= ratio * F.col("n")
    out = settle(out.select("word", F.when(has, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.low")).alias("form_n")))
    roots = _roots(out.where("form is not null").select("word", F.col("form").alias("to")))
    out = out.join(roots, out["form"] == roots["step"], "left").drop("step")
    return out.select("word", "form", F.coalesce("end", "form", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """(step, end): for each word that is a form and has one itself, the last word that forms lead to.

    Counts grow along forms, so there are no rings; each round doubles the steps taken.
    """
    forms = links.select(F.col("to").alias("word")).distinct()
    now = settle(links.join(forms, "word", "left_semi").select(F.col("word").alias("step"), F.col("to").alias("end")))
    while True:
        on = now.select(F.col("step").alias("end"), F.col("end").alias("further"))
        moved = now.join(on, "end", "left").select("step", F.coalesce("further", "end").alias("end"), F.col("further").isNotNull().alias("moved"))
        moved = settle(moved)
        now = moved.select("step", "end")
        if moved.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The words of whole texts by ``word_counts``, grouped by ``group_variants``; an empty table gives no row."""
    return group_variants(word_counts(docs, text, doc_id))
