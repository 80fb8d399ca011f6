"""From documents to training sequences: five stages, each over all that the one before kept.

Rejected documents go, one document of each group of equal texts and of each group of near copies
stays, secrets are replaced by a mark, and what is left is tokenised and packed. Stages but the last keep all columns
of their documents, whatever their names; an empty table gives an empty one; texts of any length are read whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from capturelake.llm import exact_dedup, ngram_join, packing, quality, secret_scan
from capturelake.session import checkpoint_dir


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier learned from ``labels`` accepts; null and empty texts are judged like others."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z the row of largest doc_id; null counts as empty, a repeated row stays once."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near copies the rows of least doc_id; texts without words have no copies, a repeated row stays once."""
    return ngram_join.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each secret in its text replaced by a mark and ``n_chars`` counted anew; a null text stays null."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a packed document; null and empty texts have the end id alone, repeated rows are packed as often."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", reject_low_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer cannot be said in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed documents; every stage is written to the shared folder and read again."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, rows, sf_dir).write.parquet(f"{base}/{i}")
        rows = spark.read.parquet(f"{base}/{i}")
    return rows
