"""Benchmark decontamination by templates: windows of canonical words meet in a hash join, and their slots must agree.

Numbers, the units after them, and names become typed placeholders, so a question asked again with other values has the
same template. Windows of the documents that are in no way the benchmark's are left out by a bit filter of fixed size;
the rest are joined with the benchmark's windows by their template. Along one alignment of a document with an item, each
value of the item must stand for one value of the document; two values of the item may have become one. Windows that hold
the item's own values count whatever else the alignment has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import without
from .shared import settle, small_batches

#: Words of a window, and those of a shorter item's one window that must be plain words. An item of fewer words is one window of them all.
WINDOW, LITERALS, SHORTEST = 8, 4, 4
#: Plain words of a whole window: fewer will do, as one window alone never covers enough (COVERED), and all must agree.
FEW_LITERALS = 2
#: Items of fewer than SHORTEST words, but so many at least, must stand in a document with their own values.
EXACT = 2
#: Words of an item that an alignment must cover, or all of a shorter item.
COVERED = 13
#: Bits of the filter of benchmark windows: 2 MB whatever the benchmark's size.
FILTER_BITS = 1 << 24

NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
#: Fixed words read as numbers, and as units after a number.
NUMBER_WORDS = {"zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty", "thirty", "forty", "fifty", "hundred", "thousand", "million", "half", "dozen"}
UNIT_WORDS = {
    "mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "foot", "yards", "miles", "mile", "mg", "g", "kg", "grams", "gram", "pounds", "pound", "lb", "lbs", "ounces", "tons", "ml", "l", "liters", "litres", "gallons",
    "s", "sec", "seconds", "second", "min", "minutes", "minute", "h", "hr", "hours", "hour", "days", "day", "weeks", "week", "months", "month", "years", "year", "dollars", "dollar", "cents", "cent", "euros", "euro",
    "usd", "eur", "percent", "%", "degrees", "degree", "mph", "kmh", "km/h", "m/s", "kw", "kwh", "w", "v", "hz", "points", "times",
}

_NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*")
_MEASURE = re.compile(r"([+-]?[$€£]?[0-9][0-9.,:/]*)([a-zA-Z%°]+)")
_EDGE = "\"'`.,;:!?()[]{}<>«»“”‘’*#$%&|_~-"


def _hash(word: str) -> int:
    return crc32(word.encode("utf-8", "surrogatepass"))


_NUMBER_HASH, _UNIT_HASH, _NAME_HASH = _hash(NUMBER), _hash(UNIT), _hash(NAME)


def _word(raw: str) -> list[tuple[str, str]]:
    """(template word, value) of the tokens in a raw word; the template of a capitalised word is '' as yet."""
    bare = raw.strip(_EDGE)
    if not bare:
        return []
    low = bare.lower()
    if _NUMBER.fullmatch(bare) or low in NUMBER_WORDS:
        percent = [(UNIT, "%")] if raw.rstrip("\"'.,;:!?)").endswith("%") else []
        return [(NUMBER, low.rstrip(".,")), *percent]
    if (m := _MEASURE.fullmatch(bare)) and m[2].lower() in UNIT_WORDS:
        return [(NUMBER, m[1]), (UNIT, m[2].lower())]
    if bare[0].isupper() and not (len(bare) > 1 and bare.isupper()):
        return [("", low)]
    return [(low, "")]


def _ends(raw: str) -> bool:
    """Whether a sentence ends with a raw word."""
    return raw.rstrip("\"'”’)*#$%&|")[-1:] in (".", "!", "?", ":")


def canonical(text: str | None) -> tuple[list[str], list[str]]:
    """(template words, the value of each slot or '') of a whole text; empty for a null one.

    A capitalised word is a name unless it begins a sentence, and names in a row are one; a unit word is a unit only after
    a number.
    """
    words: list[str] = []
    values: list[str] = []
    first = True
    for raw in (text or "").split():
        for template, value in _word(raw):
            if not template:
                template, value = (value, "") if first else (NAME, value)
            elif template in UNIT_WORDS and words and words[-1] == NUMBER:
                template, value = UNIT, template
            if template == NAME and words and words[-1] == NAME:
                values[-1] += f" {value}"
                continue
            words.append(template)
            values.append(value)
        first = _ends(raw)
    return words, values


#: How a token is hashed: as itself, as a name within a sentence, as a unit after a number, or as what it is everywhere.
_SELF, _NAMED, _MEASURED, _NUMERAL, _FIXED = range(5)
_KINDS = dict.fromkeys(UNIT_WORDS, _MEASURED) | dict.fromkeys(NUMBER_WORDS, _NUMERAL)
#: Raw words remembered, and characters read at once, at most (but for one longer text).
_SEEN_MOST, _AT_ONCE = 200_000, 1 << 20


class _Vocabulary(dict):
    """Raw words by code; the tokens of each code are worked out once."""

    def __init__(self) -> None:
        super().__init__()
        self.begin = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.ends = np.zeros(0, dtype=bool)
        self.hash = np.zeros(0, dtype=np.uint64)
        self.kind = np.zeros(0, dtype=np.int8)
        #: Of the words met since the arrays grew: whether a sentence ends with it, and hash and kind of its tokens.
        self.new_ends: list[bool] = []
        self.new_count: list[int] = []
        self.new_hash: list[int] = []
        self.new_kind: list[int] = []

    def __missing__(self, raw: str) -> int:
        code = self[raw] = len(self)
        bare = raw if raw.isalpha() else raw.strip(_EDGE)
        if bare.isalpha():  # the common case of what follows
            low = bare.lower()
            kind = _KINDS.get(low, _SELF)
            if kind != _NUMERAL and bare[0].isupper() and (len(bare) == 1 or not bare.isupper()):
                kind = _NAMED
            self.new_count.append(1)
            self.new_hash.append(_NUMBER_HASH if kind == _NUMERAL else crc32(low.encode("utf-8", "surrogatepass")))
            self.new_kind.append(kind)
            self.new_ends.append(bare is not raw and _ends(raw))
            if kind != _NUMERAL or bare is raw or "%" not in raw:
                return code
            for one in (self.new_count, self.new_hash, self.new_kind, self.new_ends):
                one.pop()
        tokens = [(_hash(t or v), {NUMBER: _NUMERAL, UNIT: _FIXED, "": _NAMED}.get(t) or _KINDS.get(t, _SELF)) for t, v in _word(raw)]
        self.new_count.append(len(tokens))
        self.new_hash.extend(h for h, _ in tokens)
        self.new_kind.extend(k for _, k in tokens)
        self.new_ends.append(_ends(raw))
        return code

    def grow(self) -> None:
        """Takes the words met since the last call into the arrays."""
        counts = np.array(self.new_count, dtype=np.int64)
        self.begin = np.concatenate([self.begin, len(self.hash) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.ends = np.concatenate([self.ends, np.array(self.new_ends, dtype=bool)])
        self.hash = np.concatenate([self.hash, np.array(self.new_hash, dtype=np.uint64)])
        self.kind = np.concatenate([self.kind, np.array(self.new_kind, dtype=np.int8)])
        for one in (self.new_count, self.new_hash, self.new_kind, self.new_ends):
            one.clear()


def template_hashes(texts: list[str | None], seen: _Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the template words of ``canonical``, the text that each is of), all texts at once."""
    if len(seen) > _SEEN_MOST:
        seen.clear()
        seen.__init__()
    split = [(t or "").split() for t in texts]
    lengths = np.array([len(x) for x in split], dtype=np.int64)
    words = list(chain.from_iterable(split))
    codes = np.fromiter(map(seen.__getitem__, words), dtype=np.int64, count=len(words))
    if seen.new_count:
        seen.grow()
    if not len(codes):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    first = np.ones(len(codes), dtype=bool)
    first[1:] = seen.ends[codes[:-1]]
    first[starts[lengths > 0]] = True
    count = seen.count[codes]
    token = np.repeat(seen.begin[codes] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    text = np.repeat(np.repeat(np.arange(len(texts)), lengths), count)
    out, kind = seen.hash[token], seen.kind[token]
    follows = np.zeros(len(text), dtype=bool)
    follows[1:] = text[1:] == text[:-1]
    named = (kind == _NAMED) & ~np.repeat(first, count)
    out[named] = _NAME_HASH
    after = np.zeros(len(text), dtype=bool)
    after[1:] = kind[:-1] == _NUMERAL
    out[(kind == _MEASURED) & follows & after] = _UNIT_HASH
    after[1:] = named[:-1]
    keep = ~(named & follows & after)
    return out[keep], text[keep]


def hashes(text: str | None) -> np.ndarray:
    """Hashes of the template words of ``canonical``, without making them."""
    return template_hashes([text], _Vocabulary())[0]


_PLACES, _HALF = np.uint64(FILTER_BITS - 1), np.uint64(32)


def _window_hashes(hashes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hash of the window from each place on), sizes in ascending order."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(min(max(sizes, default=0), len(hashes))):
        out = out[: len(hashes) - k]
        with np.errstate(over="ignore"):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k:]
        if k + 1 in sizes:
            yield k + 1, out


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Two bit places of the filter for each window hash."""
    return np.stack([hashes & _PLACES, (hashes >> _HALF) & _PLACES])


def _set(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each place of the filter is set."""
    places = places.astype(np.int64)
    return (bits[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def _slots(words: list[str], values: list[str], at: int, size: int) -> list[str]:
    return [values[i] for i in range(at, at + size) if words[i] in (NUMBER, UNIT, NAME)]


def _telling(words: list[str], at: int, size: int) -> bool:
    return sum(w not in (NUMBER, UNIT, NAME) for w in words[at : at + size]) >= (FEW_LITERALS if size == WINDOW else min(LITERALS, size))


def _template(words: list[str], at: int, size: int, slots: list[str]) -> str:
    """What a window is joined by: its template, with its values too where plain words are too few to tell."""
    own = " ".join(words[at : at + size])
    return own if size >= SHORTEST and _telling(words, at, size) else "\n".join([own, *slots])


def _readings(text: str | None) -> Iterator[tuple[list[str], list[str], np.ndarray]]:
    """(template words, values, hashes) of an item as it stands, and as it reads within a sentence, where its first word may be a name.

    The second is left out where the words that read alike are enough to be covered.
    """
    own = canonical(text)
    yield *own, hashes(text)
    words, values = (x[1:] for x in canonical(f"x {text or ''}"))
    if words != own[0] and len(words) - 1 < min(COVERED, len(own[0])):
        yield words, values, hashes(f"x {text or ''}")[1:]


def benchmark_windows(benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, words, at, size, template, slots, bits): the windows of each item, in both of its readings.

    Null ids and items under EXACT words have none.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, body in zip(batch["item_id"], batch["text"]):
                seen = set()
                for words, values, hashed in _readings(body):
                    size = min(WINDOW, len(words))
                    if size < EXACT:
                        continue
                    found = dict(_window_hashes(hashed, [size]))[size]
                    for at in range(len(found)):
                        slots = _slots(words, values, at, size)
                        template = _template(words, at, size, slots)
                        if (len(words), at, template) not in seen:
                            seen.add((len(words), at, template))
                            rows.append((item, len(words), at, size, template, slots, _bits(found[at : at + 1])[:, 0].astype(np.int64).tolist()))
            yield pd.DataFrame(rows, columns=["item_id", "words", "at", "size", "template", "slots", "bits"])

    own = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id is not null")
    return own.mapInPandas(cut, "item_id long, words int, at int, size int, template string, slots array<string>, bits array<long>")


def _filter(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The filter's bytes, lowest bit first, and the window sizes in use (at most WINDOW - EXACT + 1)."""
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    words = windows.select(F.explode("bits").alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int"))).alias("w"))
    for row in words.toLocalIterator():  # at most FILTER_BITS / 64 rows
        bits[row["word"]] = row["w"]
    return bits.view(np.uint8), sizes


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of _AT_ONCE characters or a little more; a longer text is a run of its own at most."""
    low, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= _AT_ONCE:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def _possible(texts: list[str | None], bits: np.ndarray, sizes: list[int], seen: _Vocabulary) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(text, its windows (place, size) that pass the filter) of the texts that have any."""
    own, text = template_hashes(texts, seen)
    begin = np.searchsorted(text, np.arange(len(texts)))
    out: dict[int, list[tuple[int, int]]] = {}
    for size, found in _window_hashes(own, sizes):
        one = np.flatnonzero(_set(bits, found & _PLACES))
        one = one[_set(bits, (found[one] >> _HALF) & _PLACES)]
        for at in one[text[one] == text[one + size - 1]].tolist():
            out.setdefault(int(text[at]), []).append((at - int(begin[text[at]]), size))
    yield from out.items()


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(key, item_id, words, covered, windows, reworded): a row for each document key and benchmark item that it holds.

    An alignment counts if its windows cover COVERED words of the item (all of a shorter one) and its slots agree, or if
    those of its windows that have the item's own values cover as many; of several, that which covers most is given. ``reworded`` is true if any value differs from the item's. The key is
    ``document_key``; rows that repeat a key count as one document.
    """
    small_batches(docs.sparkSession)
    windows = settle(benchmark_windows(benchmark))
    held = docs.sparkSession.sparkContext.broadcast(_filter(windows))  # of fixed size

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (bits, sizes), seen = held.value, _Vocabulary()
        for batch in batches:
            rows, keys, texts = [], batch["key"].tolist(), batch["text"].tolist()
            for low, high in _runs(texts):
                for i, found in _possible(texts[low:high], bits, sizes, seen):
                    words, values = canonical(texts[low + i])
                    for at, size in found:
                        slots = _slots(words, values, at, size)
                        rows.append((keys[low + i], at, _template(words, at, size, slots), slots))
            yield pd.DataFrame(rows, columns=["key", "place", "template", "own"])

    own = docs.select(document_key(text, doc_id).alias("key"), F.col(text).alias("text"))
    found = own.mapInPandas(cut, "key string, place int, template string, own array<string>")
    both = found.join(windows.drop("bits"), "template").withColumn("shift", F.col("place") - F.col("at"))
    pairs = F.collect_set(F.when(F.size("slots") > 0, F.arrays_zip("slots", "own")))
    literal = F.collect_set(F.when(F.expr("slots <=> own"), F.col("at")))
    # one window at a place of an item in an alignment: the sets are no longer than the item
    lined = both.groupBy("key", "item_id", "words", "size", "shift").agg(
        F.sort_array(F.collect_set("at")).alias("ats"), F.sort_array(literal).alias("literal"), F.array_distinct(F.flatten(pairs)).alias("pairs")
    )
    agree = F.size(F.array_distinct(F.col("pairs.slots"))) == F.size("pairs")
    lined = lined.withColumns({"whole": agree, "ats": F.when(agree, F.col("ats")).otherwise(F.col("literal"))})
    covered = F.aggregate(F.transform("ats", lambda a, i: F.least(F.col("size"), F.coalesce(F.get("ats", i + 1) - a, F.col("size")))), F.lit(0), lambda x, y: x + y)
    reworded = F.col("whole") & F.exists("pairs", lambda p: p["slots"] != p["own"])
    judged = lined.select("key", "item_id", "words", covered.alias("covered"), F.size("ats").alias("windows"), reworded.alias("reworded"))
    judged = judged.where(F.col("covered") >= F.least(F.lit(COVERED), F.col("words")))
    best = judged.groupBy("key", "item_id").agg(F.max(F.struct("covered", "windows", "words", (~F.col("reworded")).alias("same"))).alias("best"))
    return best.select("key", "item_id", "best.words", "best.covered", "best.windows", (~F.col("best.same")).alias("reworded"))


def document_key(text: str = "text", doc_id: str = "doc_id"):
    """The id as text; for a null one, a digest of the text."""
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("#"), F.sha2(F.coalesce(text, F.lit("")), 256)))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without those that hold a benchmark item, all columns and repeats kept; null and empty texts hold none.

    Only documents that may have to go are shuffled to the list of leaks.
    """
    return without(docs, document_key(text, doc_id), settle(leaks(docs, benchmark, text, doc_id).select("key").distinct()))
