"""The whole job: profile, scale, search, synthesise and append."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegralType

from rebalance.operators.scaling import Features
from rebalance.operators.synth import SEED, smote


def _as_type(value: Column, kind: DataType) -> Column:
    """A double, or a vector of doubles, in the type of the original column."""
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _as_type(x, kind.elementType))
    return (F.round(value) if isinstance(kind, IntegralType) else value).cast(kind)


def balance(
    df: DataFrame,
    label: str,
    minority: Any,
    features: str | Sequence[str],
    id_col: str | None = None,
    k: int = 5,
    over_pct: int = 100,
    seed: int = SEED,
    metric: str = "euclidean",
    blocks: int | None = None,
    num_partitions: int | None = None,
    lineage: bool = False,
) -> DataFrame:
    """``df`` with synthetic minority rows appended and marked ``is_synthetic``.

    Original rows stay as they are, and so do the types of all columns: the synthetic
    values of a feature are rounded to its type if that has less than a double.
    Columns that are neither features nor the label are null in synthetic rows.
    ``lineage`` adds seed_id, copy, nbr_id and gap.
    """
    made = smote(df, label, minority, features, id_col, k, over_pct, seed, metric, blocks, num_partitions)
    origin = ["seed_id", "copy", "nbr_id", "gap"]
    for c in Features.of(df, features).columns:
        made = made.withColumn(c, _as_type(F.col(c), df.schema[c].dataType))
    if not lineage:
        made = made.drop(*origin)
    return df.withColumn("is_synthetic", F.lit(False)).unionByName(
        made.withColumn("is_synthetic", F.lit(True)), allowMissingColumns=True
    )
