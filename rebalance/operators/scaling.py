"""Min-max scaling of named columns or of one vector column, and its inverse."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebalance.functions.vectors import double_array, not_finite
from rebalance.operators import ranges as R

CONSTANT = 0.5  # fixed value: what a column without spread is scaled to


@dataclass(frozen=True)
class Features:
    """The features of a table: numeric columns, or one vector column."""

    columns: tuple[str, ...]
    is_vector: bool

    @staticmethod
    def of(df: DataFrame, features: str | Sequence[str]) -> Features:
        columns = (features,) if isinstance(features, str) else tuple(features)
        if not columns:
            raise ValueError("no feature columns")
        is_vector = len(columns) == 1 and df.schema[columns[0]].dataType.typeName() == "array"
        return Features(columns, is_vector)

    @property
    def items(self) -> list[Column]:
        return [F.col(c).cast("double") for c in self.columns]

    @property
    def vector(self) -> Column:
        if self.is_vector:
            return F.col(self.columns[0]).cast("array<double>")
        return F.array(*self.items)

    @property
    def unusable(self) -> Column:
        """True for rows with a missing, NaN or infinite feature in a named column."""
        bad = not_finite(self.items[0])
        for item in self.items[1:]:
            bad = bad | not_finite(item)
        return bad


@dataclass(frozen=True)
class Ranges:
    """Smallest and largest value per feature."""

    mins: tuple[float, ...]
    maxs: tuple[float, ...]


@dataclass(frozen=True)
class Summary:
    """What one pass over a table tells: rows, minority rows, unusable rows, ranges."""

    num_all: int
    num_pos: int
    num_bad: int
    ranges: Ranges


def _ends(f: Features) -> list[Column]:
    return [
        fn(c).alias(f"{name}_{j}") for j, c in enumerate(f.items) for name, fn in (("min", F.min), ("max", F.max))
    ]


def _vector_parts(df: DataFrame, f: Features, positive: Column) -> DataFrame:
    """Partial sums over a vector column, at most ``R.MERGERS`` rows."""

    def merge(rows: pa.Table) -> pa.Table:
        return R.merged(rows).row(rows["bucket"][0].as_py())

    tasks = df.select(f.vector.alias("vec"), positive.alias("positive")).mapInArrow(R.task_parts, R.PARTS)
    return tasks.groupBy("bucket").applyInArrow(merge, R.PARTS)


def summarize(df: DataFrame, f: Features, positive: Column) -> Summary:
    """Class counts, ranges and the number of unusable values, in one pass."""
    if not f.is_vector:
        row = df.agg(
            F.count(F.lit(1)).alias("num_all"),
            F.count_if(positive).alias("num_pos"),
            F.count_if(f.unusable).alias("num_bad"),
            *_ends(f),
        ).first()
        ends = [tuple(row[f"{name}_{j}"] for j in range(len(f.columns))) for name in ("min", "max")]
        return Summary(row.num_all, row.num_pos, row.num_bad, Ranges(*ends))
    seen = R.merged(_vector_parts(df, f, positive).toArrow())
    uneven = int((seen.sizes != seen.sizes.max(initial=0)).sum())
    some = (~(seen.lo > seen.hi)).tolist()
    ends = [tuple(float(x) if k else None for x, k in zip(e, some, strict=True)) for e in (seen.lo, seen.hi)]
    return Summary(seen.n, seen.n_pos, seen.bad + uneven, Ranges(*ends))


def minmax_fit(df: DataFrame, features: str | Sequence[str]) -> DataFrame:
    """(col_idx, col_name, min, max) over all rows, in one pass."""
    f = Features.of(df, features)
    if f.is_vector:
        name = f.columns[0]

        def by_position(rows: pa.Table) -> pa.Table:
            seen = R.merged(rows)
            some = ~(seen.lo > seen.hi)
            return pa.table(
                {
                    "col_idx": pa.array(range(len(some)), pa.int32()),
                    "col_name": pa.array([f"{name}_{j}" for j in range(len(some))], pa.string()),
                    "min": pa.array(seen.lo, mask=~some),
                    "max": pa.array(seen.hi, mask=~some),
                }
            )

        # a row from each merger; what comes out has a row for each position
        parts = _vector_parts(df, f, F.lit(False))
        return parts.groupBy((F.col("bucket") * 0).alias("all")).applyInArrow(by_position, "col_idx int, col_name string, min double, max double")
    rows = [
        F.struct(
            F.lit(j).alias("col_idx"),
            F.lit(name).alias("col_name"),
            F.col(f"min_{j}").alias("min"),
            F.col(f"max_{j}").alias("max"),
        )
        for j, name in enumerate(f.columns)
    ]
    return df.agg(*_ends(f)).select(F.inline(F.array(*rows)))


def collect_ranges(df: DataFrame, features: str | Sequence[str]) -> Ranges:
    """The fitted ranges as a value: two numbers per feature."""
    rows = sorted(minmax_fit(df, features).collect(), key=lambda r: r.col_idx)
    return Ranges(tuple(r["min"] for r in rows), tuple(r["max"] for r in rows))


def scaled(x: Column, lo: float | None, hi: float | None, constant: float | None = CONSTANT) -> Column:
    if lo is None or hi is None or lo == hi:
        return F.when(x.isNotNull(), F.lit(constant).cast("double"))
    return (x - F.lit(lo)) / (F.lit(hi) - F.lit(lo))


def unscaled(x: Column, lo: float, hi: float) -> Column:
    return x * (F.lit(hi) - F.lit(lo)) + F.lit(lo)


def scaled_vector(f: Features, ranges: Ranges, constant: float | None = CONSTANT) -> Column:
    if not f.is_vector:
        ends = zip(f.items, ranges.mins, ranges.maxs, strict=True)
        return F.array(*[scaled(x, lo, hi, constant) for x, lo, hi in ends])
    from_low = F.zip_with(f.vector, double_array(ranges.mins), lambda x, lo: x - lo)
    return F.zip_with(
        from_low, _spans(ranges), lambda x, s: F.when(s != 0, x / s).when(x.isNotNull(), F.lit(constant).cast("double"))
    )


def _spans(ranges: Ranges) -> Column:
    return double_array([hi - lo for lo, hi in zip(ranges.mins, ranges.maxs, strict=True)])


def unscaled_vector(v: Column, ranges: Ranges) -> Column:
    stretched = F.zip_with(v, _spans(ranges), lambda x, s: x * s)
    return F.zip_with(stretched, double_array(ranges.mins), lambda x, lo: x + lo)


def minmax_transform(
    df: DataFrame,
    features: str | Sequence[str],
    ranges: Ranges,
    constant: float | None = CONSTANT,
) -> DataFrame:
    """Features scaled to [0, 1] by fitted or declared ranges.

    A feature without spread becomes ``constant``; None makes it null.
    """
    f = Features.of(df, features)
    if f.is_vector:
        return df.withColumn(f.columns[0], scaled_vector(f, ranges, constant))
    items = [scaled(x, lo, hi, constant) for x, lo, hi in zip(f.items, ranges.mins, ranges.maxs, strict=True)]
    return df.withColumns(dict(zip(f.columns, items, strict=True)))


def minmax_inverse(df: DataFrame, features: str | Sequence[str], ranges: Ranges) -> DataFrame:
    """Scaled features back in their original units."""
    f = Features.of(df, features)
    if f.is_vector:
        return df.withColumn(f.columns[0], unscaled_vector(f.vector, ranges))
    items = [unscaled(x, lo, hi) for x, lo, hi in zip(f.items, ranges.mins, ranges.maxs, strict=True)]
    return df.withColumns(dict(zip(f.columns, items, strict=True)))
