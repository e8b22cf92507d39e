"""From raw documents to packed sequences: five stages, each one operator of sitewatch.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.llm import crf_quality, ftrl, packing, simhash, suffix_dedup
from sitewatch.llm.common import checkpointed, table
from sitewatch.llm.queries import vocabulary


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python a thousand at a time: the stages share each executor's memory, and buffers stay with it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels reject go.

    Each row is judged by its own text: null and empty texts go, repeated rows and null doc_ids are taken as they are.
    """
    small_batches(spark)
    return crf_quality.keep_content(docs, table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the classifier's threshold go; each row is scored by its own text, repeated rows and null doc_ids included."""
    small_batches(spark)
    return ftrl.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest doc_id stays.

    Rows of one doc_id and text are one document; an id's other texts are documents of their own, and a null doc_id comes after all others.
    """
    small_batches(spark)
    return simhash.keep_first(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that stand earlier in the corpus leave their texts; rows neither go nor multiply.

    Rows of one doc_id and text don't repeat each other, and rows without a doc_id come after all others. A null text becomes an empty one.
    """
    small_batches(spark)
    short = suffix_dedup.shortened(docs)
    return short.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in short.columns else short


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts with their sequences of at most 2048 tokens; a null or empty text is one token, repeated rows are packed each."""
    small_batches(spark)
    return packing.packed_documents(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_duplicates", near_duplicates),
    ("suffix_array_dedup", repeated_substrings),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express none of the trained models, suffix arrays or tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is checkpointed for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = checkpointed(docs) if k < len(STAGES) - 1 else docs
    return docs
