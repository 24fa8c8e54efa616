import re
import unicodedata

import pytest
import zstandard
from basketry.llm import langid
from basketry.llm.langid import Judge, learn_dictionaries, predict_language
from basketry.llm.shared import in_fold
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return docs, learn_dictionaries(docs.where(~in_fold("doc_id", 4, 2)))


def test_held_out_accuracy(learned):
    docs, dictionaries = learned
    held = predict_language(docs.where(in_fold("doc_id", 4, 2)), dictionaries).select("lang", "lang_pred", "rejected").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in held) <= 0.02 * len(held)


def brute(text, dictionaries):
    """The language by a plain loop: letters told by their Unicode category, a new encoder for each language and text."""
    if not any(unicodedata.category(c).startswith("L") for c in text or ""):
        return "und"
    kept = "".join(c if re.match(r"\w", c) and not re.match(r"\d|_", c) else " " for c in text.lower())
    body = f" {' '.join(kept.split())} ".encode("utf-8", "replace")
    sizes = {}
    for name in sorted(dictionaries):
        content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, write_content_size=0, write_dict_id=0)
        content.precompute_compress(compression_params=settings)
        size, rest = 0, body
        while rest:
            cut = len(rest) if len(rest) <= langid.PIECE else rest[: langid.PIECE].rfind(b" ") + 1 or langid.PIECE
            size += len(zstandard.ZstdCompressor(dict_data=content, compression_params=settings).compress(rest[:cut] * 8))
            rest = rest[cut:]
        sizes[name] = size
    return min(sizes, key=lambda name: (sizes[name], name))


def test_predictions_match_a_plain_loop(spark, learned):
    _, dictionaries = learned
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(80)
    long = " ".join(r.text for r in docs.collect()) * 2
    odd = [(t,) for t in (None, "", "1 2", "é", "Straße", "x" * 70_000 + " und the", long, f"{long[:255]}", f"{long[:257]}", "a_b 3c")]
    got = predict_language(docs.unionByName(spark.createDataFrame(odd, docs.schema)), dictionaries).collect()
    assert len(got) == 90 and all(r.lang_pred == brute(r.text, dictionaries) for r in got)


def test_odd_rows(spark, learned):
    _, dictionaries = learned
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 !!", "a"), (4, "word " * 200_000, "a"), (5, "Und", None), (5, "Und", None)]
    got = sorted(predict_language(spark.createDataFrame(rows, "doc_id long, text string, score string"), dictionaries).collect())
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and all(r.rejected and r.score == 0 for r in got[:3])
    assert all(r.lang_pred in dictionaries and 0 < r.score <= 1 for r in got[3:]) and len(got) == 6
    assert predict_language(spark.createDataFrame([], "text string"), dictionaries).count() == 0
    assert Judge({}).predict("no language was learned") == ("und", 0.0, True)


def test_sample_ignores_order_ids_and_unlabelled_rows(spark):
    rows = [(i, f"text number {i % 7} of some length " * 9, ("xx", "yy", None)[i % 3]) for i in range(60)] + [(99, None, "zz"), (98, "123", "zz")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a = learn_dictionaries(frame)
    assert set(a) == {"xx", "yy"} and a == learn_dictionaries(frame.orderBy("doc_id", ascending=False).repartition(3))
    assert learn_dictionaries(frame.limit(0)) == {}


def test_copies_leave_the_sample_whole(spark):
    texts = [f"text number {i} of some length " * 9 for i in range(30)]
    frame = spark.createDataFrame([(t, "xx") for t in texts], "text string, lang string")
    once = learn_dictionaries(frame)
    copied = frame.orderBy(F.xxhash64("text")).first().text
    copies = spark.createDataFrame([(copied, "xx")] * 250, frame.schema)
    assert learn_dictionaries(frame.unionByName(copies)) == once
