"""The training-data pipeline: quality rules, quality classifier, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.
Null texts fail the quality rules; extra columns of documents are carried along to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm.bm25_packing import pack
from quarrymill.llm.eb_classifier import filter_good
from quarrymill.llm.icws_dedup import without_near_duplicates
from quarrymill.llm.llr_rules import filter_quality
from quarrymill.llm.queries import table, vocabulary_file
from quarrymill.operators.tables import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base counts and the likelihood ratio of trusted against raw text."""
    return filter_quality(docs, table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely good than bad, by their own evidence and their site's."""
    return filter_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class of near-duplicates."""
    return without_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that fill windows of 2048 ids."""
    return pack(docs, vocabulary_file("byte_bpe_50k.json"), 1, vocabulary_file("byte_bpe_50k.tiktoken"), route=("lang",))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: SQL can't express the stages' hashing, model and greedy packing; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
