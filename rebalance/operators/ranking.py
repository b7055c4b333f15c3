"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rebalance.staging import stage


def with_row_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    """A unique row key. The table is written once, so that keys never change."""
    return stage(df.withColumn(id_col, F.monotonically_increasing_id()), "row-ids")


ROW_BITS = 33  # a generated id is the partition number, then 33 bits of row number


def global_rank(df: DataFrame, *order_by: str, rank: str = "rank", unique: bool = False) -> DataFrame:
    """Dense row number 1..n in the order of ``order_by``; rows alike in it come in any order.

    Rows first get a written key. They are range-partitioned by ``order_by`` and that
    key, so a value that most rows hold is split over many tasks; then they are sorted
    and numbered within their partition, and written, which pins the numbers. The rank
    adds the number of rows in the partitions before, a table with one row per
    shuffle partition. ``unique`` tells that no two rows are alike in ``order_by``; then
    no key is needed.
    """
    keys = list(order_by) if unique else [*order_by, "_key"]
    keyed = df if unique else with_row_id(df, "_key")
    numbered = stage(
        keyed.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select(*[F.col(f"`{c}`") for c in df.columns])
        .withColumn("_number", F.monotonically_increasing_id()),
        "ranges",
    )
    part, row = F.shiftright("_number", ROW_BITS), F.col("_number").bitwiseAND((1 << ROW_BITS) - 1)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(rank, F.col("_before") + row + 1)
        .drop("_part", "_number", "_before")
    )
