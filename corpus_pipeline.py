"""Cleans ``documents`` in stages; each is written as Parquet and read again by the next.

Documents of low quality go, one of each group of near-duplicates stays, documents
with benchmark passages go, and what is left becomes SentencePiece ids. Rows with
NULL or empty texts are judged like all others; extra columns pass through to the
last stage. Each stage works on all that the one before it kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pressmill.llm import decontamination, pieces, quality, simhash
from pressmill.llm.queries import PIECE_BPE, table, tokenizer_file
from pressmill.session import removed_at_end, shared_dir


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay that the classifier, learned from the labelled ones among them, doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window like a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``round_trip`` (whether they decode to the text)."""
    return pieces.with_pieces(docs, tokenizer_file(PIECE_BPE))


STAGES = [
    ("good_quality", good_quality),
    ("near_dedup", near_dedup),
    ("decontaminated", decontaminated),
    ("sentencepiece", sentencepiece),
]

#: A trained classifier has no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        removed_at_end(spark, path)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
