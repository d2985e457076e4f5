"""Corpus pipeline: quality classifier, quality rules, near duplicates, personal data, packing.

Each stage works on all that its predecessor kept and is written as Parquet below the shared checkpoint folder. All stages but the last
return the columns of `documents`. Nulls, empty tables, repeated rows and further columns are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hiremill.llm import jaccard, packing, perplexity, pii, quality_model
from hiremill.llm.shared import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    return quality_model.keep_good(docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail the base rules or lie outside their language's perplexity band."""
    return perplexity.keep_fluent(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies."""
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; no document is dropped."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and place of every document that is left."""
    return packing.pack(docs, packing.word_length())


STAGES = [
    ("quality_classifier", quality),
    ("quality_rules", rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Trained models and components have no SQL form. Tests compare near duplicates, base rules, base spans and packing with brute-force
#: versions, and the two classifiers with the labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
