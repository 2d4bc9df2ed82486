"""The training-data pipeline: documents to clean, distinct, pseudonymous token ids.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept. Its result is written
and read again as the next one's documents. All stages but the last return the columns that they were given. A document
that is NULL or empty, or has no doc_id, passes as its operator says; extra columns are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from dialoglens.llm import decontam, jaccard, pieces, pii, quality
from dialoglens.llm.graph import small_batches
from dialoglens.llm.queries import table
from dialoglens.session import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of documents linked by five-word shingles."""
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, private values replaced by pseudonyms, and n_chars counted anew."""
    hidden = pii.with_pseudonyms(docs)
    return hidden.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else hidden


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document as little-endian 32-bit integers (`ids`), and the text that they decode to."""
    with small_batches(spark):
        return materialize(pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model")), "pieces")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("PII", hide_private),
    ("SentencePiece", to_pieces),
]

#: Hash-based scores and piece ids aren't SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
