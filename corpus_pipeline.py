"""Cleaning a text corpus: five stages, each written as Parquet and read again by the next.

1. language: documents without a recognisable language go;
2. exact copies: one document of each group of equal texts stays;
3. near copies: one document of each group of similar texts stays;
4. benchmark passages: documents that contain an item go;
5. pieces: token ids of every document left, and the text they decode to.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import contamination, exact, language, pieces, simhash
from tidemark.llm.common import give_back, stored, table


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(docs, remember=False)


STAGES = [
    ("language", keep_known_language),
    ("exact_copies", drop_exact_copies),
    ("near_copies", drop_near_copies),
    ("benchmark_passages", drop_contaminated),
    ("pieces", to_pieces),
]

# Networks, fingerprints and vocabularies have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is stored in the shared folder until the next one is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        give_back(before)
    return docs
