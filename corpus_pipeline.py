"""A training corpus in stages: each takes (spark, docs, folder) and returns the next stage's docs.

Null and empty texts pass the filters unless the classifier rejects them by its bias. Columns beyond
those of ``documents`` are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oddlot.llm.containment import without_items
from oddlot.llm.packing import pack_sequences
from oddlot.llm.parity_join import keep_one
from oddlot.llm.quality import good_documents
from oddlot.llm.recompression import cut_texts
from oddlot.llm.store import written
from oddlot.session import ship


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more stay."""
    ship(spark)
    return good_documents(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    ship(spark)
    return keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut out."""
    ship(spark)
    return cut_texts(docs)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    ship(spark)
    return without_items(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token sequences of what is left."""
    ship(spark)
    return pack_sequences(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Training, hashing and tokenizing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if place < len(STAGES) - 1:
            docs = written(docs)
    return docs
