import hashlib
import string
from collections import defaultdict

import pytest
from basketry.llm import contentsort
from pyspark.sql import functions as F

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    """doc_id -> (keep_id, group_size, kept, sha256), for distinct ids."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    return {d: (max(ids), len(ids), d == max(ids), hashlib.sha256(norm.encode()).hexdigest()) for norm, ids in groups.items() for d in ids}


def outcome(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = contentsort.exact_duplicates(docs)
    assert got.columns == [*docs.columns, *contentsort.MADE]
    assert outcome(got) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_only_a_to_z_is_folded(spark):
    rows = [(1, "Ärger"), (2, "ärger"), (3, "ÄRGER"), (4, "Ärger "), (5, "İI"), (6, "İi"), (7, None), (8, ""), (9, "x" * 300_000 + "A"), (10, "X" * 300_000 + "a"), (11, "x" * 300_000 + "b")]
    assert outcome(contentsort.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


@pytest.mark.parametrize("ranges", [2, 16])
def test_a_text_of_a_third_of_all_rows_is_dealt_over_ranges(spark, ranges):
    rows = [(i, "Same head of all the texts here, and more: " + ("hot" if i % 3 == 0 else "Hot" if i % 30 == 1 else str(i % 700))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert outcome(contentsort.exact_duplicates(docs, ranges=ranges)) == brute(rows)


def test_case_variants_under_one_hot_hash(spark):
    """Texts that lower() folds together but A to Z does not share a hash, and stay apart."""
    rows = [(i, ("É" if i % 2 else "é") + "tat") for i in range(400)] + [(1000, "x")]
    assert outcome(contentsort.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), ranges=8)) == brute(rows)


def test_smallest_id_may_stay(spark):
    rows = [(3, "a"), (2, "A"), (5, "b")]
    got = contentsort.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), keep="smallest")
    assert {r.doc_id: (r.keep_id, r.kept) for r in got.collect()} == {3: (2, False), 2: (2, True), 5: (5, True)}


def test_nulls_and_repeated_rows(spark):
    rows = [(None, "a"), (None, "A"), (None, "b"), (4, "b"), (7, "c"), (7, "c"), (7, "d")]
    got = contentsort.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted(((r.text.lower(), r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got.collect()))
    assert found == [("a", 0, 0, 2, False), ("a", 0, 0, 2, True), ("b", 0, 4, 2, False), ("b", 4, 4, 2, True), ("c", 7, 7, 2, False), ("c", 7, 7, 2, True), ("d", 7, 7, 1, True)]


def test_empty_tables_and_clashing_columns(spark):
    rows = [(1, "a", "x", "y", 5, "z"), (2, "A", "x", "y", 6, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, part string, group_size long, `all` string")
    got = contentsort.exact_duplicates(docs)
    assert got.columns == ["doc_id", "text", "h", "part", "all", *contentsort.MADE]
    assert {(r.doc_id, r.h, r.part, r["all"], r.group_size, r.kept) for r in got.collect()} == {(1, "x", "y", "z", 2, False), (2, "x", "y", "z", 2, True)}
    assert contentsort.exact_duplicates(docs.limit(0)).count() == 0
    left = contentsort.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and [r.group_size for r in left.collect()] == [6]


def test_no_python_and_one_shuffle_of_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = contentsort.exact_duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in plan.split("rangepartitioning")[0]


def test_query(spark):
    import duckdb
    from basketry.llm import queries

    root = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op12_exact_dedup"]).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.QUERIES["op12_exact_dedup"](spark, root).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert list(got.columns) == list(want.columns) and got.equals(want.astype(got.dtypes))
