"""From raw documents to packed training sequences, in stages that are each written and read again.

Every stage but the last gives the columns of ``documents``. A stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language_id, near_dup, packing, pu_quality, secret_scan
from millrace.session import stage


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return pu_quality.keep_good(docs, pu_quality.train(docs, labels))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted."""
    return language_id.keep_accepted(docs, language_id.train(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies, texts that share four fifths of their shingles."""
    return near_dup.keep_first(docs, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced and their lengths counted anew."""
    return secret_scan.redact(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as packed sequences, one row per piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good_texts),
    ("language", known_language),
    ("near duplicates", one_of_each),
    ("secrets", without_secrets),
    ("packing", pack),
]
# Trained models and packing are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
