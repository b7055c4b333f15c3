"""Random draws that depend only on (seed, row, copy), never on partitioning.

A draw is a slice of an md5 digest, so a recomputed or moved task gives the
same numbers, and any SQL engine with md5 can repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_GAP_DIGITS = 13  # 52 bits: every value is an exact double


def digest(seed: int, tag: str, *keys: Column) -> Column:
    parts = [k.cast("string") for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *parts))


def _slice(hexdigest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(hexdigest, start, digits), 16, 10).cast("bigint")


def draw32(hexdigest: Column) -> Column:
    """Integer in [0, 2^32) from the first eight digits."""
    return _slice(hexdigest, 1, 8)


def draw_unit(hexdigest: Column) -> Column:
    """Double in [0, 1) from the thirteen digits after those of ``draw32``."""
    return _slice(hexdigest, 9, _GAP_DIGITS).cast("double") / float(16**_GAP_DIGITS)
