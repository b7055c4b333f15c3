"""Column expressions on feature vectors (``ARRAY<DOUBLE>``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "manhattan")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")
    return metric


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def euclidean(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance, terms added left to right."""
    return F.sqrt(_sum(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column | str, b: Column | str) -> Column:
    """Manhattan distance, terms added left to right."""
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: F.abs(x - y)))


def distance(a: Column | str, b: Column | str, metric: str = "euclidean") -> Column:
    return {"euclidean": euclidean, "manhattan": manhattan}[check_metric(metric)](a, b)


def interpolate(seed: Column | str, neighbor: Column | str, gap: Column | str) -> Column:
    """Point at ``gap`` (0..1) on the segment from ``seed`` to ``neighbor``."""
    g = _col(gap)
    return F.zip_with(_col(seed), _col(neighbor), lambda s, n: s + (n - s) * g)


def as_vector(columns: Sequence[str]) -> Column:
    """Named numeric columns as one vector."""
    return F.array(*[F.col(c).cast("double") for c in columns])


def not_finite(c: Column) -> Column:
    """True for null, NaN and infinite numbers."""
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def double_array(values: Sequence[float]) -> Column:
    """A literal vector; the text form keeps every bit and is folded once."""
    text = ",".join(repr(float(v)) for v in values)
    return F.split(F.lit(text), ",").cast("array<double>")
