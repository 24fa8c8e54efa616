import pytest
from basketry.llm import decontaminate as dc


def brute(docs, items):
    """(doc, item) pairs by comparing canonical texts at every shift."""
    out = {}
    for d, text in docs:
        dw, dv = dc.canonical(text)
        for i, body in items:
            bw, bv = dc.canonical(body)
            size = min(dc.WINDOW, len(bw))
            if size < dc.SHORTEST:
                continue
            for shift in range(-len(bw), len(dw) + 1):
                ats = [a for a in range(len(bw) - size + 1) if 0 <= a + shift <= len(dw) - size and dw[a + shift : a + shift + size] == bw[a : a + size]]
                ats = [a for a in ats if sum(w not in (dc.NUMBER, dc.UNIT, dc.NAME) for w in bw[a : a + size]) >= min(dc.LITERALS, size)]
                cover = {a + k for a in ats for k in range(size)}
                pairs = {(bv[c], dv[c + shift]) for c in cover if bw[c] in (dc.NUMBER, dc.UNIT, dc.NAME)}
                ok = len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
                if ats and ok and len(cover) >= min(dc.COVERED, len(bw)):
                    out[d, i] = max(out.get((d, i), 0), len(cover))
    return out


ITEMS = [
    (1, "A farmer called Anna Bell sold 12 apples and 7 pears to the old mill, then 12 apples more."),
    (2, "How far is it by train?"),
    (3, "no"),
    (4, None),
    (5, ""),
]
DOCS = [
    (1, "Text before. A farmer called Anna Bell sold 12 apples and 7 pears to the old mill, then 12 apples more. And after."),
    (2, "x y A farmer called Carl Dunn sold 30 apples and 9 pears to the old mill, then 30 apples more"),
    (3, "A farmer called Carl Dunn sold 30 apples and 9 pears to the old mill, then 31 apples more"),
    (4, "how far is it BY train? "),
    (5, "A farmer went by train. No."),
    (6, None),
    (7, ""),
]


def test_canonical_words():
    text = "We paid Bob $5.50 for 3 kg, or 20% of Ann's 4km in May. May 5 dollars? Two"
    words, values = dc.canonical(text)
    assert words == ["we", "paid", "<name>", "<number>", "for", "<number>", "<unit>", "or", "<number>", "<unit>", "of", "<name>", "<number>", "<unit>", "in", "<name>", "may", "<number>", "<unit>", "<number>"]
    assert values[2] == "bob" and values[13] == "km"
    for t in (text, None, "", "% 5 % km 5% km. X 5 -- km Y", "A B. C 5km min"):
        assert dc.hashes(t).tolist() == [dc._hash(w) for w in dc.canonical(t)[0]]


def test_pairs_match_brute_force(spark):
    docs = spark.createDataFrame(DOCS + [(8, "filler word " * 30_000 + ITEMS[0][1]), (1, DOCS[0][1]), (None, DOCS[0][1])], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS + [(None, ITEMS[0][1])], "item_id long, text string")
    got = {(r.key, r.item_id): r for r in dc.leaks(docs, items).collect()}
    want = brute(DOCS, ITEMS)
    assert {(str(d), i) for d, i in want} | {("8", 1)} == {k for k in got if k[0][0] != "#"}
    assert len(got) == len(want) + 2 and all(got[str(d), i].covered == n for (d, i), n in want.items())
    assert got["2", 1].reworded and not got["1", 1].reworded and ("3", 1) not in got
    assert sorted(r.doc_id for r in dc.drop_leaks(docs, items).collect()) == [3, 5, 6, 7]
    assert dc.drop_leaks(docs, items.limit(0)).count() == 10 and dc.leaks(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("size", ["sf0.01"])
def test_planted_passages_are_found_and_clean_documents_left(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    items = spark.read.parquet(f"/root/testdata/{size}/benchmark.parquet")
    squeezed = lambda t: " ".join((t or "").lower().split())
    bodies = [squeezed(r.text) for r in items.collect()]
    want = {r.doc_id for r in docs.collect() if any(b in squeezed(r.text) for b in bodies)}
    assert {int(r.key) for r in dc.leaks(docs, items).collect()} == want and want


def test_collided_values_changed_copies_and_windows_of_values(spark):
    long = "A farmer called Anna Bell sold 12 apples and 7 pears to the old mill near the river bridge, then he bought 12 more apples there."
    values = "we counted 3 4 5 6 7 8 9 10 11 12 13 14 15 16"
    items = spark.createDataFrame([(1, long), (2, values), (3, "what is love"), (4, "paid 5 euros")], "item_id long, text string")
    docs = [
        (1, long.replace("12", "4").replace("7", "4").replace("Anna", "Carl")),  # two values become one
        (2, long.replace("bought 12", "bought 13")),  # one of two occurrences is changed
        (3, f"so {values} in all"),
        (4, values.replace("10", "20")),
        (5, "but what is love then"),
        (6, "he paid 5 euros, she paid 6 euros"),
        (7, "he paid 6 euros for what love is"),
        (8, long.replace("12", "4", 1).replace("12", "5").replace("7", "9")),  # one value cannot become two
    ]
    got = {(int(r.key), r.item_id): r for r in dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (5, 3), (6, 4)}
    assert got[1, 1].reworded and got[3, 2].covered == 16 and got[2, 1].covered < got[2, 1].words


def test_short_items_names_in_a_row_and_clashing_columns(spark):
    items = [(1, "Add 2 and 3"), (2, "What is 7 times 8?"), (3, "Go on now"), (4, "The clerk Anna Bell gave the old man 20 coins for the red boat and then went home.")]
    docs = [(1, "Say: Add 2 and 3 at once"), (2, "what is 7 times 8? 56"), (3, "so Go on now then"), (4, "Yesterday the clerk Bob gave the old man 31 coins for the red boat and then went home."), (5, "Add 4 and 5"), (6, "what is 6 times 8?")]
    frame = spark.createDataFrame([(*d, "k", 1, True, 0) for d in docs], "doc_id long, text string, _key string, key int, maybe boolean, row int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(int(r.key), r.item_id) for r in dc.leaks(frame, bench).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4)}
    kept = dc.drop_leaks(frame, bench)
    assert kept.columns == frame.columns and sorted((r.doc_id, r._key, r.row) for r in kept.collect()) == [(5, "k", 0), (6, "k", 0)]
    assert dc.canonical("so Anna Maria Bell went, Carl stayed")[1] == ["", "anna maria bell", "", "carl", ""]


QUESTIONS = [
    "What is {0} + {1} - {2} times {3} divided by {4} plus {0} minus {1} equal to {5}?",
    "If {6} has {0} boxes of {1} pens and {7} has {2} boxes of {3} pens, how many pens do {6} and {7} have in all?",
    "A train leaves at {0} and runs {1} km at {2} km/h, rests {3} minutes, then runs {4} km at {5} km/h. When does it arrive?",
    "{6} paid {0} dollars for {1} kg of rice and {2} dollars for {3} kg of beans; how much is one kg of each?",
    "Let x = {0} and y = {1} and z = {2} . What is {3} x + {4} y - {5} z ?",
]


def test_reparameterised_questions_are_found_and_others_left(spark):
    """Recall and precision on questions full of numbers asked again with other values, among texts with as many numbers."""
    import random

    draw = random.Random(8)
    names = ["Anna", "Bob", "Carla", "Dan", "Ella", "Fred"]
    fill = lambda q: q.format(*draw.sample(range(2, 900), 6), *draw.sample(names, 2))
    items = [(i, fill(q)) for i, q in enumerate(QUESTIONS)]
    copies = [(i * 100 + k, f"Some text goes before it. {fill(q)} And more text after it.") for i, q in enumerate(QUESTIONS) for k in range(20)]
    others = [(10_000 + k, " ".join(draw.choice(["we", "paid", "for", "and", "the", "plus", "of", "at", "kg", "Anna", "Bob"]) if draw.random() < 0.5 else str(draw.randrange(900)) for _ in range(80))) for k in range(300)]
    docs = spark.createDataFrame(copies + others, "doc_id long, text string")
    found = {(int(r.key), r.item_id) for r in dc.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    right = {(d, d // 100) for d, _ in copies}
    assert len(found & right) >= 0.9 * len(right) and len(found & right) >= 0.99 * len(found)
