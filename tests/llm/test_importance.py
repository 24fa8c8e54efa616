import hashlib
import math
import re
import string
import zlib
from collections import Counter

import pytest
from basketry.llm import importance, queries
from pyspark.sql import functions as F

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=5, min_words=20, buckets=10_000):
    """(doc_id, n_features, weight, score, rank) by the definition, plain loops only."""
    place = lambda g: zlib.crc32(g.encode()) % buckets
    made = [(d, *grams(t)) for d, t in docs]
    s, t = Counter(place(g) for _, _, gs in made for g in gs), Counter(place(g) for x in target for g in grams(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows, may = [], []
    for d, n, gs in made:
        weight = sum(gain[place(g)] for g in gs)
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= min_words:
                may.append((-score, d))
        rows.append((d, len(gs), weight, score))
    drawn = {d: i + 1 for i, (_, d) in enumerate(sorted(may)[: percent * len(may) // 100])}
    return sorted(((*r, drawn.get(r[0])) for r in rows), key=str)


def outcome(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query_matches_brute_force(spark):
    root = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{root}/benchmark.parquet").select("text").collect()]
    assert outcome(queries.QUERIES["op13_importance_resampling"](spark, root)) == brute(docs, target)


ODD = [None, "", " .,-\n", "a", "A b", "ÀÉ×÷ ß​日本 x1y2Z", "don't stop_me-now 3.14", "w" * 5000 + " " + "é" * 3000 + " end", "x" * 47 + " " + "y" * 48 + " " + "z" * 49, "one two three " * 40_000, "\x7f\x00a\x00b", "q" * 33 + "\n" + "ü" * 31]


def test_odd_texts_match_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    target = ["a b c", None, "one two", "日本"]
    frame = spark.createDataFrame([(t,) for t in target], "text string")
    weighed = importance.with_weights(docs, importance.learn_gains(docs, frame))
    got = importance.draw(importance.with_scores(weighed), percent=50, min_words=1)
    assert outcome(got) == brute(rows, target, 50, 1)


def test_nothing_depends_on_partitions_or_pieces(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    first = importance.learn_gains(docs, target)
    assert importance.learn_gains(docs.repartition(7), target.repartition(3)) == first
    monkeypatch.setattr(importance, "_PIECE", 1000)
    again = importance.with_weights(docs.repartition(5), importance.learn_gains(docs, target))
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight").collect())
    assert importance.learn_gains(docs, target) == first and key(again) == key(importance.with_weights(docs, first))


def scored(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, n_words long, score long").withColumn("n_features", F.lit(0)).withColumn("weight", F.lit(0))


@pytest.mark.parametrize("percent", [0, 1, 5, 50, 100])
def test_ties_go_to_the_smaller_id(spark, percent):
    rows = [(i * 7 % 1000, 20 if i % 10 else 19, i % 3) for i in range(1000)]
    may = sorted((-s, d) for d, n, s in rows if n >= 20)
    want = {d: i + 1 for i, (_, d) in enumerate(may[: percent * len(may) // 100])}
    got = importance.draw(scored(spark, rows).repartition(5), percent)
    ranks = {r.doc_id: r["rank"] for r in got.collect()}
    assert len(ranks) == 1000 and {d: r for d, r in ranks.items() if r} == want


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, 50, 10), (1, 50, None), (2, 50, 7), (2, 50, 7), (2, 50, 7), (3, 50, 9), (4, 2, 99)]
    got = sorted(((r.doc_id or 0, r["rank"] or 0) for r in importance.draw(scored(spark, rows), 50).collect()))
    assert got == [(0, 0), (1, 0), (2, 0), (2, 0), (2, 2), (3, 1), (4, 0)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    gains = importance.learn_gains(empty, empty)
    assert set(gains) == {0}
    assert importance.draw(importance.with_scores(importance.with_weights(empty, gains))).count() == 0


def test_clashing_columns_and_texts(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 30, "keep", 7.5) for i in range(40)], "doc_id long, text string, _may string, weight double")
    target = spark.createDataFrame([("w3 w3 w3",)], "text string")
    got = importance.resample(docs, target, percent=10)
    assert got.columns == ["doc_id", "text", "_may", "weight", "score", "rank"]
    rows = got.collect()
    assert sorted(r["rank"] for r in rows) == [1, 2, 3, 4] and all(r._may == "keep" and r.text == f"w{r.doc_id} " * 30 for r in rows)
    assert min(rows, key=lambda r: r["rank"]).doc_id == 3


def test_draw_leans_towards_the_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    target = docs.where("doc_id % 7 = 1").select("text").limit(30)
    gains = importance.learn_gains(docs, target)
    drawn = importance.draw(importance.with_scores(importance.with_weights(docs, gains)), 20)
    mean = drawn.groupBy(F.col("rank").isNotNull().alias("drawn")).agg(F.avg(F.col("weight") / F.col("n_features")).alias("w")).collect()
    found = {r.drawn: r.w for r in mean}
    assert found[True] > found[False]
