"""Language ID by compression: a text goes to the language whose zstandard dictionary encodes it in the fewest bytes."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, with_fields

UNKNOWN = "und"
#: The bounded sample that a dictionary is made of: texts of each language, and bytes of each dictionary.
SAMPLE_TEXTS, DICTIONARY_BYTES = 96, 112 << 10
#: Compression level.
LEVEL = 5
#: Bytes by which the best language must beat the next for each 1,000 bytes of text, and at least. Below, a text is rejected.
MARGIN_PER_1000, MARGIN_LEAST = 2.0, 1
#: Every text is encoded so many times over: one short text alone would be stored as it is, in the same bytes for all languages.
REPEATS = 8
#: Bytes of the pieces that a longer text is encoded in, all of which count; a piece ends with a word.
PIECE = 1 << 16


def learn_dictionaries(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Raw dictionary content by language, from a sample of at most SAMPLE_TEXTS distinct whole texts of each.

    The sample is what comes first by a hash of the text, so it does not hang on row order, partitions or ids;
    texts of 200 to 20,000 characters come before others. Rows without a language or text teach nothing.
    """
    known = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    known = known.where(F.col("text").rlike(r"\p{L}"))
    known = known.withColumns({"_rare": F.when(F.length("text").between(200, 20_000), 0).otherwise(1), "_hash": F.xxhash64("text")})
    # copies would take the places of other texts; only hashes are shuffled to leave them out, and few of those reach a language's one task
    order = ("_rare", "_hash")
    first = known.select("lang", *order).distinct()
    for groups in (256, 16, 1):
        first = first.withColumn("_part", F.pmod("_hash", F.lit(groups)))
        first = first.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_n") <= SAMPLE_TEXTS)
    # as bounded as the dictionaries: SAMPLE_TEXTS rows of a language
    ranked = known.join(F.broadcast(first.drop("_part")), ["lang", *order]).select("lang", "_n", "text").distinct()
    out: dict[str, bytes] = {}
    parts: dict[str, list[bytes]] = {}
    for row in ranked.orderBy("lang", "_n", "text").toLocalIterator():
        own = parts.setdefault(row["lang"], [])
        if len(own) == SAMPLE_TEXTS or sum(map(len, own)) >= DICTIONARY_BYTES:
            continue
        own.append(letters_only(row["text"]))
    for name, own in parts.items():
        out[name] = b"".join(reversed(own))[-DICTIONARY_BYTES:]
    return out


class Judge:
    """Encoders of all languages; built once in each worker."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.names = sorted(dictionaries)
        self.encoders = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_dict_id=0)
            content.precompute_compress(compression_params=settings)  # else each call digests the dictionary again
            self.encoders.append(zstandard.ZstdCompressor(dict_data=content, compression_params=settings))

    def sizes(self, text: str) -> list[int]:
        pieces = [p * REPEATS for p in _pieces(letters_only(text))]
        return [sum(len(e.compress(p)) for p in pieces) for e in self.encoders]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected). The score is the best language's share of weights that halve with each 1 % more bytes."""
        if text is None or not self.names or not has_letter(text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        best = min(sizes)
        ties = [i for i, s in enumerate(sizes) if s == best]
        first = ties[0]
        margin = min((s - best for i, s in enumerate(sizes) if i != first), default=best)
        weights = [2.0 ** (-100.0 * (s - best) / max(best, 100)) for s in sizes]
        bytes_ = len(text.encode("utf-8", "replace"))
        return self.names[first], 1.0 / sum(weights), margin < max(MARGIN_LEAST, MARGIN_PER_1000 * min(bytes_, 1000) / 1000)


_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> bytes:
    """What is encoded: the lower-cased words, one space before and after each; marks and digits tell no language."""
    return _NOT_LETTERS.sub(" ", f" {text.lower()} ").encode("utf-8", "replace")


def _pieces(letters: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(letters):
        stop = start + PIECE
        if stop < len(letters):
            stop = letters.rfind(b" ", start + 1, stop) + 1 or stop  # a word longer than a piece is cut
        yield letters[start:stop]
        start = stop


_JUDGES: dict[tuple, Judge] = {}


def _judge(dictionaries: dict[str, bytes]) -> Judge:
    """The worker's one judge, kept between tasks: encoders are large, and not to be made for each."""
    key = tuple(sorted((name, crc32(content)) for name, content in dictionaries.items()))
    if key not in _JUDGES:
        _JUDGES.clear()
        _JUDGES[key] = Judge(dictionaries)
    return _JUDGES[key]


def has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


def predict_language(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """docs with columns lang_pred, score and rejected.

    Null texts and those without a letter get ``und``, score 0 and are rejected; so are narrow margins, which keep
    their nearest language. Whole texts are encoded. All columns and repeated rows stay; of clashing names, these
    three replace the old ones.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)  # of bounded size

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        predict = _judge(held.value).predict
        return pd.DataFrame([predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return with_fields(docs, judge(F.col(text)), ["lang_pred", "score", "rejected"])
