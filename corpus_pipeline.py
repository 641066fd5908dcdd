"""The corpus pipeline: quality rules, near-dedup, substring dedup, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclonet.llm import near_dedup, packing, pii, quality, substrings
from cyclonet.llm.common import bound_batches, materialize, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it now is, where the table has that column."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and blank texts go, as they have too few words; repeated rows are judged alike. Columns stay as they are.
    """
    bound_batches(spark)
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that of the least doc_id, ties by the least hash of the text.

    Of repeated rows one stays; null and empty texts are one class.
    """
    bound_batches(spark)
    return near_dedup.keep_one(docs, 0.8)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a repeated window of 35 words go; their documents stay, with what is left (null: as it was)."""
    bound_batches(spark)
    return _counted(substrings.rewrite_documents(docs, 35))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced; texts without any, null ones too, stay as they are."""
    return _counted(pii.sanitize(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens: one row for each piece; a null or empty text is its end token."""
    bound_batches(spark)
    return packing.pack(docs, 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("personal_data", personal_data),
    ("pack_sequences", pack_sequences),
]

#: The near-duplicate and packing stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each on what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
