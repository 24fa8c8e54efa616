import random

import xxhash
from basketry.llm.components import connected_components
from basketry.llm.simhash import BKTree, fingerprint, fingerprint_links, keep_one, simhash_components


def brute_shingles(text, k):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = (words + [word] if word else words), ""
        else:
            word += c
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])


def brute_fingerprint(text, k=3):
    shingles = brute_shingles(text, k)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    out = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return out - (1 << 64) if out >> 63 else out


def brute_components(rows, shingles=None, similarity=0.8):
    """(doc_id, fp) -> component ids by comparing all pairs; with shingles, pairs that share ``similarity`` of them are linked too."""
    sets = [set(s) for s in shingles or []]
    like = lambda a, b: len(a & b) / max(1, len(a | b)) >= similarity
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ((rows[i][1] ^ rows[j][1]) & (1 << 64) - 1).bit_count() <= 3 or shingles and like(sets[i], sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(rows))]


def test_fingerprint_matches_its_definition():
    for text in (None, "", " \n\t", "One", "Two words", "a b c", "A b c d\x0be f É É É", "x " * 500 + "y z", "a b c d"):
        assert fingerprint(text) == brute_fingerprint(text)


def test_tree_search_equals_scan():
    draw = random.Random(5)
    values = [draw.getrandbits(64) for _ in range(20)]
    values += [v ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for v in values for _ in range(5)]
    tree = BKTree()
    for v in values:
        tree.add(v)
    for q in values:
        assert sorted(tree.within(q, 3)) == sorted(v for v in set(values) if (v ^ q).bit_count() <= 3)


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    want = {d: (f, c) for (d, f), c in zip(rows, brute_components(rows))}
    got = simhash_components(docs).collect()
    assert {r.doc_id: (r.fp, r.component_id) for r in got} == want and len(got) == len(rows)


def test_dense_groups_split_over_trees_lose_no_link(spark):
    draw = random.Random(7)
    base = draw.getrandbits(64)
    values = {base}
    for _ in range(120):
        v = draw.choice(sorted(values))
        for _ in range(draw.randrange(1, 6)):
            v ^= 1 << draw.randrange(64)
        values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = brute_components(list(zip(signed, signed)))
    for nodes in (4, 2048):
        roots = {r.node: r.root for r in connected_components(fingerprint_links(frame, 3, nodes)).collect()}
        group = [roots.get(v, v) for v in signed]
        assert len(set(group)) == len(set(want))
        assert len(set(zip(group, want))) == len(set(want))


def test_odd_rows(spark):
    rows = [(5, None, 1), (3, "", 2), (None, " ", 3), (7, "a b c d", 4), (7, "a b c d", 4), (9, "A B C d", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash_components(docs).collect())
    assert got == [(-1, 3), (3, 3), (5, 3), (7, 7), (7, 7), (9, 7)]
    kept = keep_one(docs, null_ids=True)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 7]
    assert keep_one(docs.limit(0)).count() == 0
    assert simhash_components(docs.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    chain = spark.range(1, 400).selectExpr("id as u", "id - 1 as v")
    got = connected_components(chain.unionByName(spark.createDataFrame([(1000, 1001), (None, 4)], "u long, v long"))).collect()
    assert {r.root for r in got if r.node < 400} == {0} and len(got) == 402


def test_rows_without_ids_are_deduplicated_in_the_pipeline(spark):
    from corpus_pipeline import near_duplicates

    rows = [(None, "one two three four five", 1), (None, "one two three four five", 1), (None, "six seven eight nine ten", 2), (4, "six seven eight nine ten", 2), (None, None, 3), (None, " ", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    kept = near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.fp) for r in kept.collect()) == [(-1, 1), (-1, 3), (4, 2)]


def test_similar_texts_are_linked_whatever_their_fingerprints(spark, monkeypatch):
    """Chains and groups of copies at 0.7 to 0.9 of shared shingles, in blocks of several sizes, against all pairs."""
    from basketry.llm import simhash

    draw = random.Random(11)
    texts = [" ".join(f"w{draw.randrange(10_000)}" for _ in range(draw.choice((3, 6, 40, 120)))) for _ in range(12)]
    for _ in range(110):
        words = draw.choice(texts[-60:]).split()
        for _ in range(draw.choice((0, 1, 1, 2, 3))):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10_000)}"
        texts.append(" ".join(words).upper() if draw.random() < 0.2 else " ".join(words))
    rows = [(i if i % 17 else None, t) for i, t in enumerate([*texts, *texts[:9], "", None])]
    draw.shuffle(rows)
    groups = brute_components([(i, brute_fingerprint(t, 5)) for i, t in rows], [brute_shingles(t, 5) for _, t in rows])
    named, docs = {g for g in groups if g is not None}, spark.createDataFrame([(*r, 0, "r") for r in rows], "doc_id long, text string, maybe int, row string")
    for block in (3, 1024):
        monkeypatch.setattr(simhash, "BLOCK_TEXTS", block)
        kept = keep_one(docs).collect()
        assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(named) and kept[0].row == "r"
    tops = brute_components([(n, brute_fingerprint(t, 5)) for n, (_, t) in enumerate(rows)], [brute_shingles(t, 5) for _, t in rows])
    assert len(kept) == len(set(tops))
