"""Category dictionaries, and rows as numbers or as text.

A dictionary says which label of a column has which code. It is either a
mapping ``{column: {label: code}}`` (declared, as in a header) or a DataFrame
(col_name, label, code), such as ``category_dictionary`` finds in a table.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from rebalance.functions.text import trimmed
from rebalance.operators.ranking import global_rank
from rebalance.operators.scaling import scaled
from rebalance.staging import stage

Dictionary = Mapping[str, Mapping[str, float]] | DataFrame


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns marked numeric in their metadata, else columns of a number type."""
    fields = df.schema.fields
    if any("kind" in f.metadata for f in fields):
        return [f.name for f in fields if f.metadata.get("kind") == "numeric"]
    return [f.name for f in fields if isinstance(f.dataType, NumericType)]


def attribute_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(col_idx, col_name, kind, min, max) per column; ranges of numeric columns."""
    numeric = set(numeric_columns(df))
    columns = list(columns or df.columns)
    ranged = [c for c in columns if c in numeric]
    nothing = F.lit(None).cast("double")
    rows = [
        F.struct(
            F.lit(j).alias("col_idx"),
            F.lit(c).alias("col_name"),
            F.lit("numeric" if c in numeric else "categorical").alias("kind"),
            (F.col(f"min_{j}") if c in numeric else nothing).alias("min"),
            (F.col(f"max_{j}") if c in numeric else nothing).alias("max"),
        )
        for j, c in enumerate(columns)
    ]
    ends = [
        f(F.col(c).cast("double")).alias(f"{name}_{columns.index(c)}")
        for c in ranged
        for name, f in (("min", F.min), ("max", F.max))
    ]
    return df.agg(F.count(F.lit(1)).alias("n"), *ends).select(F.inline(F.array(*rows)))


def category_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col_name, label, code): codes 0, 1, ... in label order, per column.

    The dictionary is written once, so joins with it know its size.
    """
    pairs = [
        F.struct(F.lit(c).alias("col_name"), trimmed(F.col(c).cast("string")).alias("label")) for c in columns
    ]
    labels = df.select(F.inline(F.array(*pairs))).where(F.col("label").isNotNull()).distinct()
    ranked = global_rank(labels, "col_name", "label", unique=True)
    # one row per column
    starts = ranked.groupBy("col_name").agg(F.min("rank").alias("start"))
    codes = ranked.join(F.broadcast(starts), "col_name").select(
        "col_name", "label", (F.col("rank") - F.col("start")).cast("double").alias("code")
    )
    return stage(codes, "dictionary")


def _number(text: Column, on_error: str) -> Column:
    if on_error not in ("fail", "reject"):
        raise ValueError("on_error must be 'fail' or 'reject'")
    return text.cast("double") if on_error == "fail" else text.try_cast("double")


def _with_codes(
    df: DataFrame, columns: Sequence[str], dictionary: Dictionary, on_error: str
) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` ready to be projected, and the code of every column.

    A label that the dictionary lacks is read as a number. Declared labels are
    looked up in a literal map; others come by an equi-join per column, which
    Catalyst broadcasts if the dictionary's measured size allows it.
    """
    codes: dict[str, Column] = {}
    if isinstance(dictionary, DataFrame):
        for j, c in enumerate(columns):
            part = dictionary.where(F.col("col_name") == c).select(
                F.col("label").alias(f"_label_{j}"), F.col("code").alias(f"_code_{j}")
            )
            text = trimmed(F.col(c).cast("string"))
            df = df.join(part, text == F.col(f"_label_{j}"), "left")
            # a number is read just where the dictionary has no entry
            codes[c] = F.when(F.col(f"_label_{j}").isNotNull(), F.col(f"_code_{j}")).otherwise(
                _number(text, on_error)
            )
        return df, codes
    for c in columns:
        declared = dictionary.get(c)
        plain = F.col(c)
        if not declared:
            is_text = df.schema[c].dataType.typeName() == "string"
            codes[c] = _number(trimmed(plain), on_error) if is_text else plain.cast("double")
            continue
        text = trimmed(plain.cast("string"))
        found = F.from_json(F.lit(json.dumps(declared)), "map<string,double>")[text]
        codes[c] = F.when(found.isNotNull(), found).otherwise(_number(text, on_error))
    return df, codes


def _split_columns(df: DataFrame, columns: Sequence[str], dictionary: Dictionary, categorical):
    """Of ``columns``, those that need the dictionary."""
    if isinstance(dictionary, DataFrame):
        return [c for c in columns if c in (categorical or [])]
    return list(columns)


def _codes(df, columns, dictionary, categorical, on_error):
    coded = _split_columns(df, columns, dictionary, categorical)
    out, codes = _with_codes(df, coded, dictionary, on_error)
    _, rest = _with_codes(df, [c for c in columns if c not in coded], {}, on_error)
    return out, codes | rest


def encode_labeled(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    dictionary: Dictionary | None = None,
    categorical: Sequence[str] = (),
    keep: Sequence[str] = (),
    on_error: str = "fail",
) -> DataFrame:
    """(keep..., features ARRAY<DOUBLE>, label, label_code).

    ``categorical`` names the columns to code when the dictionary is a
    DataFrame; list the label there to have it coded, else it must be a number.
    Without a dictionary all columns are numbers.
    """
    out, codes = _codes(df, [*features, label], dictionary or {}, categorical, on_error)
    return out.select(
        *keep,
        F.array(*[codes[c] for c in features]).alias("features"),
        trimmed(F.col(label).cast("string")).alias("label"),
        codes[label].alias("label_code"),
    )


def encode_rows(
    df: DataFrame,
    columns: Sequence[str],
    dictionary: Dictionary | None = None,
    categorical: Sequence[str] = (),
    keep: Sequence[str] = (),
    label: str | None = None,
    label_as: str = "code",
    as_text: bool = False,
    keep_numeric_text: bool = False,
    delimiter: str = ",",
    on_error: str = "fail",
) -> DataFrame:
    """Rows with categories as codes: double columns, or one ``value`` text.

    ``label`` is added as the last column, coded (``label_as='code'``) or as it
    stands (``'text'``). ``keep_numeric_text`` leaves numbers as written.
    """
    if label_as not in ("code", "text"):
        raise ValueError("label_as must be 'code' or 'text'")
    every = [*columns, *([label] if label else [])]
    coded = [c for c in every if not (c == label and label_as == "text")]
    out, codes = _codes(df, coded, dictionary or {}, categorical, on_error)
    if label and label_as == "text":
        codes[label] = F.col(label)
    if not as_text:
        return out.select(*keep, *[codes[c].alias(c) for c in every])
    if keep_numeric_text:
        has_codes = set(categorical) if isinstance(dictionary, DataFrame) else set(dictionary or {})
        codes = {c: code if c in has_codes else F.col(c) for c, code in codes.items()}
    return out.select(
        *keep, F.concat_ws(delimiter, *[codes[c].cast("string") for c in every]).alias("value")
    )


def normalize_declared(
    df: DataFrame,
    columns: Sequence[str],
    dictionary: Mapping[str, Mapping[str, float]],
    ranges: Mapping[str, tuple[float, float]],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Numbers scaled by their declared range, categories as codes.

    A declared range without spread gives null.
    """
    out, codes = _with_codes(df, columns, dictionary, "fail")
    return out.select(
        *keep,
        *[(scaled(codes[c], *ranges[c], constant=None) if c in ranges else codes[c]).alias(c) for c in columns],
    )


def numeric_view(
    df: DataFrame,
    label: str,
    positive: str = "positive",
    columns: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The numeric columns, and 1.0 for the positive label, 0.0 for all others."""
    columns = [c for c in (columns or numeric_columns(df)) if c != label and c not in keep]
    is_positive = F.coalesce(trimmed(F.col(label).cast("string")) == positive, F.lit(False))
    return df.select(
        *keep,
        *[F.col(c).cast("double").alias(c) for c in columns],
        F.when(is_positive, 1.0).otherwise(0.0).alias("label"),
    )


def decode_label(
    df: DataFrame, code: str, dictionary: Dictionary, column: str, label: str = "label"
) -> DataFrame:
    """The label a code stands for, added as ``label``."""
    if isinstance(dictionary, DataFrame):
        names = dictionary.where(F.col("col_name") == column).select(
            F.col("code").alias("_code"), F.col("label").alias("_label")
        )
        named = df.join(names, F.col(code) == F.col("_code"), "left")
        return named.withColumn(label, F.col("_label")).drop("_code", "_label")
    by_code = {str(float(v)): k for k, v in dictionary[column].items()}
    names = F.from_json(F.lit(json.dumps(by_code)), "map<string,string>")
    return df.withColumn(label, names[F.col(code).cast("double").cast("string")])


def explode_features(df: DataFrame, names: Sequence[str], features: str = "features") -> DataFrame:
    """A vector column as one column per item."""
    rest = [c for c in df.columns if c != features]
    return df.select(*rest, *[F.col(features)[j].alias(n) for j, n in enumerate(names)])
