import math
import re
from collections import Counter

import pytest
from basketry.llm import quality_rules as rules
from pyspark.sql import functions as F


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_rules_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, " \n\t\n"), (-4, "a b c a b c"), (-5, "a a a a a"), (-6, "é# *$%&|<> \x0b x\x85y"), (-7, "l\nl \nl\n\nl"), (-8, "a b c d " * 20_000), (-8, "a b c d " * 20_000)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    got = rules.base_rules(docs).select("doc_id", "text", *FIELDS).collect()
    assert len(got) == 1009
    for r in got:
        assert tuple(r[f] for f in FIELDS) == brute(r.text), r.doc_id


def bucket(spark, grams):
    frame = spark.createDataFrame([(list(g),) for g in grams], "g array<string>")
    out = frame.select("g", *(F.pmod(F.xxhash64(F.lit(n), *(F.get("g", F.lit(k)) for k in range(n))), F.lit(rules.BUCKETS)).alias(f"n{n}") for n in (1, 2)))
    return {tuple(r.g): r[f"n{len(r.g)}"] for r in out.collect()}


def test_ratio_matches_brute_force(spark):
    docs = spark.createDataFrame([(1, "a b a b c"), (2, "c d"), (3, None), (4, "x"), (4, "x")], "doc_id long, text string")
    trusted = spark.createDataFrame([(1,), (1,), (9,), (None,)], "doc_id long")
    texts = {1: "a b a b c".split(), 2: ["c", "d"], 3: [], 4: ["x"]}
    grams = {d: [(x,) for x in w] + list(zip(w, w[1:])) for d, w in texts.items()}
    place = bucket(spark, {g for gs in grams.values() for g in gs})
    raw = Counter(place[g] for d in (1, 2, 3, 4, 4) for g in grams[d])
    target = Counter(place[g] for g in grams[1])
    s, b = rules.SMOOTHING, rules.BUCKETS
    want = {g: math.log((target[p] + s) / (sum(target.values()) + s * b)) - math.log((raw[p] + s) / (sum(raw.values()) + s * b)) for g, p in place.items()}
    ratios = rules.log_ratios(docs, trusted)
    assert all(ratios[place[g]] == pytest.approx(v, abs=1e-4) for g, v in want.items())
    got = {r.doc_id: r.llr for r in rules.judge(docs, ratios).collect()}
    assert got[3] is None
    for d in (1, 2, 4):
        assert got[d] == pytest.approx(sum(want[g] for g in grams[d]) / len(grams[d]), abs=1e-4)
    assert rules.judge(docs.limit(0), ratios).count() == 0


def test_verdict_follows_quality_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged = rules.judge(docs, rules.log_ratios(docs, labels.where("quality = 1 and doc_id % 2 = 0")))
    rows = judged.join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.99 and kept[0] < 0.05


def test_all_trusted_documents_are_counted(spark):
    """Where all documents are trusted, both multinomials are one, however many there are."""
    ids = spark.range(60_000).withColumnRenamed("id", "doc_id")
    last = ids.orderBy(F.xxhash64("doc_id").desc()).first().doc_id
    docs = ids.withColumn("text", F.when(F.col("doc_id") == last, "rare").otherwise("common"))
    assert set(rules.log_ratios(docs, ids)) == {0.0}


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b", "w", "l", "s", "r")], "doc_id long, text string, _words string, _lines string, _starts string, n_words string")
    got = rules.judge(docs, [0.0] * rules.BUCKETS).first()
    assert (got._words, got._lines, got._starts, got.n_words, got.text) == ("w", "l", "s", 2, "a b")


def test_an_overfull_filter_changes_no_count(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('w', id % 7, ' x', id % 11, ' y', id % 3) as text")
    trusted = spark.range(0, 3000, 3).withColumnRenamed("id", "doc_id")
    assert rules.log_ratios(docs, trusted, blocks=1) == rules.log_ratios(docs, trusted)
