"""The stages of the corpus pipeline.

Each takes (spark, docs, sf_dir) and gives a DataFrame. All but the last keep the columns
of documents. Rows are judged by their text: ids may be missing or repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebalance.llm import decontaminate, neardup, pieces, pii, quality
from rebalance.llm.common import table
from rebalance.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality.judge(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))
    return judged.where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; five-word shingles, similarity 0.8."""
    return neardup.one_of_each(docs, width=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of personal data replaced by its kind."""
    found = pii.find(docs)
    clean = pii.masked(F.col("text"), F.col("spans")).alias("text")
    return found.select(*[clean if c == "text" else F.col(c) for c in docs.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document with an end id, and the text they decode to."""
    return pieces.encode(docs, tokenizer()).drop("text").withColumnRenamed("decoded", "text")
