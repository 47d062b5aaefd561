"""Corpus preparation: filter, deduplicate, cut repeats, pack. Run by ``run(spark, sf_dir)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm.common import table
from tidegauge.llm.exact_dedup import without_duplicates
from tidegauge.llm.packing import packed_documents
from tidegauge.llm.rules import passing
from tidegauge.llm.simhash import without_near_duplicates
from tidegauge.llm.suffixes import without_repeats
from tidegauge.session import materialise

#: Words of a shingle, and bits that fingerprints of near copies may differ in: those of op1.
SHINGLE, MAX_DISTANCE = 4, 4


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the isolation forest rejects go."""
    return passing(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints hang together the one with the smallest doc_id stays."""
    return without_near_duplicates(docs, SHINGLE, MAX_DISTANCE)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur twice or more are cut out of the texts."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of each document, with its sequence and place."""
    return packed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: SQL can't express the isolation forest, fingerprints or packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
