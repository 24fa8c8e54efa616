import random
import re
import string
import zlib
from collections import Counter, defaultdict

from basketry.llm import queries, spelling

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_counts(docs, least=7, often=2):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= least
    return {w: n for w, n in found.items() if n >= often}


def brute_near(words):
    """Near words by their patterns with one letter left open, and by what is left when a letter goes."""
    near, same, shorter = defaultdict(set), defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            same[w[:i], w[i + 1 :]].add(w)
            shorter[w[:i] + w[i + 1 :]].add(w)
    for group in same.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for longer in shorter[w]:
            near[w].add(longer)
            near[longer].add(w)
    return near


def brute(counts):
    near, form = brute_near(counts), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return rows


def outcome(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def test_query_matches_brute_force(spark):
    root = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(brute_counts(docs))
    assert outcome(queries.QUERIES["op11_spelling_variants"](spark, root)) == want
    assert sum(1 for r in want if r[1]) > 50


def test_dense_words_lose_no_link(spark):
    """Words of two or three letters repeat their bigrams, so that prefixes are full of ties."""
    rng = random.Random(5)
    counts = {"".join(rng.choice("abé"[:k]) for _ in range(rng.choice((7, 8, 9)))): rng.choice((2, 3, 20, 40, 500)) for k in (2, 3) for _ in range(700)}
    counts |= {"a" * n: 2 for n in (7, 8, 9, 10)}
    assert outcome(spelling.group_variants(frame(spark, counts))) == brute(counts)


def test_chains_ties_and_long_words(spark):
    base = "x" * 3 + "qwertyuiop" * 300
    counts = {"aaaabbbb": 2, "aaaabbbc": 20, "aaaabbcc": 200, "aaaabccc": 2000, "aaaacccc": 20000, "tiedwora": 50, "tiedworb": 50, "tiedword": 5, base: 2, base[:1500] + base[1501:]: 30, "lonelyword": 9, "ünïcödë": 2, "ünicödë": 20}
    got = outcome(spelling.group_variants(frame(spark, counts)))
    assert got == brute(counts)
    rows = {r[0]: r for r in got}
    assert rows["aaaabbbb"][2] == "aaaacccc" and rows["tiedword"][1] == "tiedwora" and rows["lonelyword"][1:5] == (None, "lonelyword", 9, 0)


def test_counts_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "ABCDEFGÀ abcdefgÀ abcdefgà"), (None, "nullidword " * 3), (5, "seven77seven7sevens sevens sevenss sevenss"), (5, "sevenss sevenss"), (6, "Möglichkeit÷möglichkeit × möglichkeit"), (7, "longest" * 200 + " " + "longest" * 200), (8, "repeated " * 50_000)]
    rows += [(i, "commonword otherwords") for i in range(100, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    assert got == brute_counts(rows) and len({len(w) for w in got if w.startswith("commonw")}) <= 2
    assert outcome(spelling.spelling_variants(docs)) == brute(brute_counts(rows))


def test_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "wordwords wordwords", "k", 3)], "doc_id long, text string, word string, n int")
    assert outcome(spelling.spelling_variants(docs)) == brute(brute_counts([(1, "wordwords wordwords")]))
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_a_word_of_any_length_has_few_tokens(spark):
    word = "longest" * 20_000
    docs = spark.createDataFrame([(1, f"{word} {word} {word[:-1]} {word[:-1]}")], "doc_id long, text string")
    words = spelling.word_counts(docs, one_in=1 << 40)
    assert spelling.tokens(words, spelling.gram_order(words)).count() <= 14
    assert {(len(r.word), r.n, r.n_near) for r in spelling.group_variants(words).collect()} == {(140_000, 2, 1), (139_999, 2, 1)}


def test_one_edit_of_long_and_short_words(spark, monkeypatch):
    pairs = [("abcdefg", "abcdefg"), ("abcdefg", "abcxefg"), ("abcdefg", "abcdfg"), ("bcdefg", "abcdefg"), ("abcdefg", "abcdefgh"), ("abcdefg", "abxdexg"), ("abcdefg", "bcdefga"), ("aaaaaaa", "aaaaaa"), ("ünïcödé", "ünïcöde"), ("abcdef", "xabcdeg")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    want = [b in brute_near({a, b})[a] for a, b in pairs]
    for plain in (64, 0):
        monkeypatch.setattr(spelling, "PLAIN", plain)
        assert [r[0] for r in frame.select(spelling.one_edit("a", "b")).collect()] == want


def test_pivots_are_disjoint_and_rarest():
    for prefix in ([(0, 5), (1, 1), (2, 9)], [(0, 3), (1, 3), (2, 1), (5, 2)], [(1, 7), (2, 2), (3, 3), (6, 9)]):
        first, second = spelling.pivots_of(prefix)
        place = dict(prefix)
        least = min(place[a] + place[b] for a in place for b in place if b >= a + 2)
        assert second >= first + 2 and place[first] + place[second] == least
