"""Small helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\f\r"
GAP = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, or the empty text for a null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(column: str | Column) -> Column:
    """Array of the words between blanks; empty for a null or blank text."""
    trimmed = F.btrim(text_of(column), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def row_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice of several rows has over ``most`` bytes in ``column``."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def byte_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of every text, empty for nulls."""
    return batch.column(column).cast(pa.binary()).fill_null(b"").to_pylist()
