"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contentsort, decontaminate, fm, htmltext, importance, mixing, quality_rules, spelling, urlfilter, warc
from .langid import learn_dictionaries, predict_language
from .pii import pii_digest
from .shared import in_fold, read, settle
from .simhash import hex_fingerprint, simhash_components


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its fingerprint in hex and the smallest doc_id that links reach.

    Null, empty and blank texts have fingerprint zero and are linked like any others; a null doc_id keeps its row; repeated rows are
    all given.
    """
    found = simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds, word for word or re-parameterised.

    Null and empty texts hold none; a document without an id has a null doc_id here; rows that repeat an id count as one document.
    """
    out = decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select(F.col("key").try_cast("long").alias("doc_id"), "item_id", "words", "covered", "windows", "reworded")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, from dictionaries of the documents outside the held-out fold.

    Null texts and those without a letter are ``und`` with score 0; a null doc_id is never held out and teaches nothing.
    """
    docs = read(spark, sf_dir, "documents")
    held_out = in_fold("doc_id", 4, 2)
    dictionaries = learn_dictionaries(docs.where(F.col("doc_id").isNotNull() & ~held_out))
    out = predict_language(docs.select("doc_id", "text"), dictionaries)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


#: The list of bad URLs that op4 filters by, hosts with all their subdomains. Another list is another table of URLs.
LISTED = [f"http://{name}.example.{zone}/" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for zone in ("com", "net", "org")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each page's url; null or malformed urls have empty host and path and are allowed."""
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    out = urlfilter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), listed)
    return out.select("page_id", "host", "path", "rule", "verdict", "listed")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rate and copies of each document; a null or empty text has no tokens, repeated rows the same rate each."""
    docs, targets = read(spark, sf_dir, "documents").select("doc_id", "text"), mixing.TARGETS
    model = mixing.learn_domains(docs, read(spark, sf_dir, "labels"), list(targets))
    members = settle(mixing.with_posteriors(docs, model).drop("text"))  # texts are read once
    out = mixing.with_rates(members, mixing.fit_rates(members, targets), text=None)
    shares = [F.get("posterior", F.lit(i)).alias(f"p_{name}") for i, name in enumerate(sorted(mixing.TARGETS))]
    return out.select("doc_id", "tokens", *shares, "rate", "copies")


_OP4_SQL = f"""
WITH split AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
canonical AS (
  SELECT *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)[.]', '') AS own, own || regexp_replace(path, '/+$', '') AS canon FROM split),
bad AS (SELECT unnest([{", ".join(f"'{u.removeprefix('http://').rstrip('/')}'" for u in LISTED)}]) AS entry),
ruled AS (
  SELECT c.*, len([e FOR e IN (SELECT list(entry) FROM bad) IF e = canon OR ends_with('.' || own, '.' || e)]) > 0 AS listed,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM canonical c)
SELECT page_id, host, path, rule, listed,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page through an archive and back; a null html is an empty payload, repeated pages are records of their own."""
    out = warc.round_trip(spark, read(spark, sf_dir, "pages")).where("problem is null")  # it raises if a record is missing
    return out.select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to")
    )


_OP6_SQL = """
WITH own AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
hashed AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) || '0' AS hex FROM own),
best AS (SELECT hex, max(page_id) AS first FROM hashed GROUP BY hex)
SELECT page_id, payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + (((('0x' || substr(h.hex, 1 + (5 * i) // 4, 2))::INTEGER) >> (3 - (5 * i) % 4)) & 31)::INTEGER, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM hashed h JOIN best b ON h.hex = b.hex
"""


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of each document; null and empty texts are scored as empty, a null doc_id is never held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = in_fold("doc_id", 5, 0)
    out = fm.score(docs.select("doc_id", "text", "n_chars"), fm.learn(docs.where(~held_out), labels.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each document; a null text has no words and fails."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = quality_rules.log_ratios(docs, read(spark, sf_dir, "labels").where("quality = 1"))
    return quality_rules.judge(docs, ratios).drop("text")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page; null and empty html give an empty text, repeated rows are all given."""
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data of each document; null and empty texts have none."""
    out = pii_digest(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.drop("text")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each word of seven letters and two occurrences: its form, root and near words; null texts have no words."""
    return spelling.spelling_variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: the id that stays of its equal texts, and how many there are; a null text is the empty one."""
    out = contentsort.exact_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.drop("text")


_OP12_SQL = """
WITH own AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
grouped AS (SELECT doc_id, norm, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM own WINDOW w AS (PARTITION BY norm))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM grouped
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of each document, drawn towards the benchmark; null texts weigh 0, a null doc_id is never drawn."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    gains = importance.learn_gains(docs, read(spark, sf_dir, "benchmark"))
    weighed = importance.with_weights(docs, gains).drop("text")
    return importance.draw(importance.with_scores(weighed)).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_url_filter": op4_url_filter,
    "op5_mixing": op5_mixing,
    "op6_warc": op6_warc,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_quality_rules": op8_quality_rules,
    "op9_main_text": op9_main_text,
    "op10_pii": op10_pii,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL: dict[str, str] = {"op4_url_filter": _OP4_SQL, "op6_warc": _OP6_SQL, "op12_exact_dedup": _OP12_SQL}
