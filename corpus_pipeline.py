"""A training corpus from raw documents in five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import decontaminate, langid, mixing, pii, simhash
from basketry.llm.shared import gone_at_exit, read, shared_dir


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as ``_row``, whose columns no operator's own can replace."""
    return docs.select("doc_id", "text", F.struct("*").alias("_row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; dictionaries are learned from the labelled ones given."""
    dictionaries = langid.learn_dictionaries(docs)
    judged = langid.predict_language(_carried(docs), dictionaries)
    return judged.where(~F.col("rejected")).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five words, a similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks, n_chars counted anew."""
    cleaned = pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))
    return cleaned.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture uses, with rate and the copies to make of each."""
    mixed = mixing.mix(_carried(docs), read(spark, sf_dir, "labels"))
    kept = [F.col(f"_row.{c}") for c in docs.columns if c not in ("rate", "copies")]
    return mixed.where("copies > 0").select(*kept, "rate", "copies")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("mixing to target weights", mixture),
]

#: Compression dictionaries, hashes and fitted rates have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is kept in the shared folder until the driver's JVM ends."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        gone_at_exit(spark, path)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
