"""The training-data pipeline: language ID, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import best_fit, language_id, mixing, order_minhash, secret_links
from gridloom.llm.common import saved, table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter and doubtful ones go."""
    return language_id.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id."""
    return order_minhash.survivors(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every credential found replaced by the name of its kind."""
    return secret_links.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as their source's word target takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of bounded length: (bin_id, doc_id, start, n_words, offset)."""
    return best_fit.pack(docs)


STAGES = [
    ("language_id", languages), ("near_dedup", near_duplicates), ("secret_scan", secrets), ("source_mix", mixed),
    ("best_fit_packing", packed),
]
# Learned weights, sketches and rounding are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
