"""From raw documents to clean, deduplicated, tokenised ones, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read again before the next. All but the last keep the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rebalance.llm.common import table
from rebalance.llm.stages import benchmark_decontamination, near_dedup, private_data, quality_rules, token_ids
from rebalance.staging import stage


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", private_data),
    ("sentencepiece", token_ids),
]

#: Signatures, edit distances and merges have no SQL form; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return step_last(spark, docs, sf_dir)


def step_last(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name, step = STAGES[-1]
    return stage(step(spark, docs, sf_dir), name)
