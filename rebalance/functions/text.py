"""Helpers for text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\v"  # fixed value: what may surround a field


def trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))
