"""Corpus pipeline: each stage calls one operator and returns the documents that it leaves, as the next one's input.

Stages take (spark, docs, sf_dir); what one returns is written as Parquet and read again for the next. All but the last
return the columns of documents. NULL texts and texts without a letter go in the first stage, which fills lang with its
prediction where it is NULL; from then on every stage has the rows its operator defines for ties, repeated rows and empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, exact_dedup, language, mixing, ngram_join
from tidemark.operators.ordering import ensure_checkpoint_dir, settle
from tidemark.sources.tables import remove


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, their lang filled where it is NULL."""
    return language.in_a_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id."""
    return ngram_join.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken and what they derive from."""
    weights = mixing.label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mix(docs, weights).filter("taken > 0")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("decontamination", benchmark_leaks),
    ("mixing", mixture),
]

#: Language ID and MinHash banding can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with a table in the shared folder between them that goes once the next one is written."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            remove(spark, f"{folder}/{before}")
        before = name
    # Ids, sizes and words taken; the texts are no longer needed.
    mixed = settle(STAGES[-1][1](spark, docs, sf_dir))
    remove(spark, folder)
    return mixed
