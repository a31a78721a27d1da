"""Corpus cleaning from quality filter to packed sequences; each stage applies one training-data operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomwatch.llm import exact_dedup, near_dup, packing, quality, substring_dedup
from loomwatch.llm.common import shared_dir, vocabulary
from loomwatch.session import ship


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality.keep_good(docs, labels)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that differ in white space only, one stays."""
    ship(spark)
    return exact_dedup.keep_distinct(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8), one stays."""
    ship(spark)
    return near_dup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words of whose bytes each lies in a 200-byte string that occurs more than once go from the text (fifty words
    are hardly ever fewer bytes); n_chars follows."""
    ship(spark)
    return substring_dedup.cut_repeats(docs, length=200, min_words=50)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their place in packed sequences."""
    ship(spark)
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), 1, 4096)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packing_stage),
]

#: The classifier, the Jaccard join over 64-bit shingles and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
