"""Class balance, the oversampling budget and partition sizes."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def num_classes(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count_distinct(label).alias("num_classes"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """(label, count, pct) per class, with the total and the number of classes."""
    per_class = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    # classes stay spread out; the totals are one row
    totals = per_class.agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("num_classes"))
    both = per_class.withColumn("_t", totals.select(F.struct("total", "num_classes")).scalar())
    return both.select(
        "label", "count", "_t.total", F.expr("count * 100 div _t.total").alias("pct"), "_t.num_classes"
    )


def is_minority(label: str, minority: Any) -> Column:
    return F.col(label) == F.lit(minority)


def class_counts(label: str, minority: Any) -> list[Column]:
    """Aggregates for the number of rows and of minority rows, in one pass."""
    return [
        F.count(F.lit(1)).alias("num_all"),
        F.count_if(is_minority(label, minority)).alias("num_pos"),
    ]


def budget(counts: DataFrame, over_pct: int | Sequence[int], k: int) -> DataFrame:
    """The plan, one row per percentage, for a one-row frame with ``num_all`` and ``num_pos``."""
    wanted = [over_pct] if isinstance(over_pct, int) else list(over_pct)
    every = F.array(*[F.lit(int(p)).cast("bigint") for p in wanted])
    numbers = counts.withColumn("num_neg", F.expr("num_all - num_pos")).withColumn("over_pct", F.explode(every))
    numbers = numbers.withColumn("target", F.expr("num_neg * over_pct div 100"))
    numbers = numbers.withColumn("num_syn", F.expr("greatest(target - num_pos, 0L)"))
    return numbers.select(
        "num_all",
        "num_pos",
        "num_neg",
        F.expr("num_pos * 100 div nullif(num_all, 0)").alias("pos_pct"),
        F.expr("num_neg * 100 div nullif(num_all, 0)").alias("neg_pct"),
        "over_pct",
        "target",
        "num_syn",
        F.expr("num_syn div nullif(num_pos, 0)").alias("base_copies"),
        F.expr("num_syn % nullif(num_pos, 0)").alias("extra_seeds"),
        F.sqrt(F.col("num_pos").cast("double")).alias("sqrt_num_pos"),
        F.lit(int(k)).cast("bigint").alias("k"),
    )


def check_percentage(*over_pct: int) -> None:
    if not over_pct or min(over_pct) <= 0:
        raise ValueError("over_pct must be greater than 0")


def sampling_plan(
    df: DataFrame, label: str, minority: Any, over_pct: int | Sequence[int] = 100, k: int = 5
) -> DataFrame:
    """One row per percentage: counts, target, rows to create and copies per seed.

    However many percentages there are, the table is read once.

    The minority is to reach ``floor(num_neg * over_pct / 100)`` rows. Every
    minority row is copied ``base_copies`` times, ``extra_seeds`` of them once more.
    """
    check_percentage(*([over_pct] if isinstance(over_pct, int) else over_pct))
    return budget(df.agg(*class_counts(label, minority)), over_pct, k)


def check_plan(plan: Row) -> Row:
    """Refuse a minority that has no k other rows."""
    if plan.num_pos <= plan.k:
        raise ValueError(f"{plan.num_pos} minority rows, but more than k={plan.k} are needed")
    return plan


def balance_report(df: DataFrame, label: str, minority: Any) -> DataFrame:
    """Final counts, and the minority as a percentage of all other rows."""
    return report(df.agg(*class_counts(label, minority)))


def report(counts: DataFrame) -> DataFrame:
    """The report for a one-row frame with ``num_all`` and ``num_pos``."""
    return counts.select(
        "num_pos",
        F.expr("num_all - num_pos").alias("num_neg"),
        F.expr("num_pos * 100 div nullif(num_all - num_pos, 0)").alias("pos_pct"),
        F.expr("case when num_all > num_pos then 100L end").alias("neg_pct"),
    )


def partition_profile(df: DataFrame) -> DataFrame:
    """Rows per partition: least, most, integer mean, and number of partitions.

    Counted where the rows are, with one row per partition shuffled.
    """

    rows = df.select(F.spark_partition_id().alias("part"))
    every = rows.rdd.getNumPartitions()  # from the plan: empty partitions have no row to be counted by
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    filled = F.count(F.lit(1))
    return sizes.agg(
        F.when(filled < every, 0).otherwise(F.coalesce(F.min("n"), F.lit(0))).cast("bigint").alias("min_rows"),
        F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("max_rows"),
        F.coalesce(F.expr(f"sum(n) div {max(every, 1)}"), F.lit(0)).cast("bigint").alias("avg_rows"),
        F.lit(every).cast("bigint").alias("num_partitions"),
    )
