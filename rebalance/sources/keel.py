"""KEEL header and data files, and delimited text output."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from rebalance.functions.text import trimmed

# The header lines and brackets of the KEEL format.
INPUTS = "@inputs"
ATTRIBUTE = re.compile(r"^\s*@attribute\s+('[^']*'|\"[^\"]*\"|[^\s{\[]+)\s*(.*)$", re.IGNORECASE)
CLASS_NAME = "class"


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: str  # numeric, categorical or class
    labels: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None

    def field(self) -> StructField:
        if self.kind == "numeric":
            about = {"kind": "numeric"}
            if self.low is not None:
                about |= {"min": self.low, "max": self.high}
            return StructField(self.name, DoubleType(), True, about)
        return StructField(self.name, StringType(), True, {"kind": self.kind, "labels": list(self.labels)})


@dataclass(frozen=True)
class KeelSchema:
    """The columns a header declares, class last."""

    attributes: tuple[Attribute, ...]

    @property
    def label(self) -> str:
        return self.attributes[-1].name

    @property
    def features(self) -> list[str]:
        return [a.name for a in self.attributes[:-1]]

    @property
    def columns(self) -> list[str]:
        return [a.name for a in self.attributes]

    @property
    def classes(self) -> tuple[str, ...]:
        return self.attributes[-1].labels

    @property
    def num_classes(self) -> int:
        return len(self.classes)

    @property
    def numeric_columns(self) -> list[str]:
        return [a.name for a in self.attributes if a.kind == "numeric"]

    @property
    def dictionary(self) -> dict[str, dict[str, float]]:
        return {
            a.name: {label: float(code) for code, label in enumerate(a.labels)}
            for a in self.attributes
            if a.labels
        }

    @property
    def ranges(self) -> dict[str, tuple[float, float]]:
        return {a.name: (a.low, a.high) for a in self.attributes if a.low is not None}

    def struct_type(self) -> StructType:
        return StructType([a.field() for a in self.attributes])

    def dictionary_frame(self, spark: SparkSession) -> DataFrame:
        """(col_idx, col_name, label, code)"""
        rows = [
            (j, a.name, label, float(code))
            for j, a in enumerate(self.attributes)
            for code, label in enumerate(a.labels)
        ]
        return spark.createDataFrame(rows, "col_idx int, col_name string, label string, code double")


def _inside(text: str, opening: str, closing: str) -> list[str]:
    return [part.strip() for part in text[text.index(opening) + 1 : text.rindex(closing)].split(",")]


def parse_header(text: str) -> KeelSchema:
    inputs, attributes, last = None, [], None
    for line in text.splitlines():
        if line.strip().lower().startswith(INPUTS[:-1]):  # @input and @inputs
            inputs = len(line.split(","))
        match = ATTRIBUTE.match(line)
        if not match:
            continue
        name, rest = match[1].strip("'\""), match[2]
        if name.lower() == CLASS_NAME:
            last = Attribute(name, "class", tuple(_inside(rest, "{", "}")))
        elif "[" in rest:
            low, high = _inside(rest, "[", "]")
            attributes.append(Attribute(name, "numeric", (), float(low), float(high)))
        elif "{" in rest:
            attributes.append(Attribute(name, "categorical", tuple(_inside(rest, "{", "}"))))
        else:
            attributes.append(Attribute(name, "numeric"))
    if inputs is None or last is None:
        raise ValueError("the header needs an @inputs line and a class attribute")
    if inputs != len(attributes):
        raise ValueError(f"the header names {inputs} inputs but declares {len(attributes)}")
    return KeelSchema((*attributes, last))


def read_keel_header(spark: SparkSession, path: str) -> KeelSchema:
    """The columns a header file declares; it has one line per column."""
    return parse_header(spark.read.text(path, wholetext=True).first().value)


def _counted_fields(line: Column, delimiter: str) -> Column:
    """Number of fields; empty ones at the end do not count."""
    trimmed = F.regexp_replace(line, rf"({re.escape(delimiter)})+\z", "")
    return F.size(F.split(trimmed, re.escape(delimiter)))


def _fits(line: Column, width: int, delimiter: str) -> Column:
    return (F.length(line) > 0) & (_counted_fields(line, delimiter) == width)


def _is_directive(line: Column) -> Column:
    return F.startswith(trimmed(line), F.lit("@"))


def well_formed(lines: DataFrame, width: int, delimiter: str = ",", value: str = "value") -> DataFrame:
    """Data lines with exactly ``width`` fields."""
    line = F.col(value)
    return lines.where(~_is_directive(line) & _fits(line, width, delimiter))


def rejects(lines: DataFrame, width: int, delimiter: str = ",", value: str = "value") -> DataFrame:
    """Data lines that ``well_formed`` leaves out, with their number of fields."""
    line = F.col(value)
    return lines.where(~_is_directive(line) & ~_fits(line, width, delimiter)).withColumn(
        "n_fields", F.when(F.length(line) > 0, _counted_fields(line, delimiter)).otherwise(0)
    )


def _declared(attribute: Attribute, text: Column) -> Column:
    """True for declared labels and for numbers; of a class, for the codes of its labels."""
    number = text.try_cast("double")
    if attribute.kind == "class":
        coded = number.isin(*[float(j) for j in range(len(attribute.labels))])
    else:
        coded = number.isNotNull()
    return F.coalesce(text.isin(*attribute.labels) | coded, F.lit(False))


def _parsed(lines: DataFrame, schema: KeelSchema, delimiter: str, on_error: str) -> DataFrame:
    parts = F.split("value", re.escape(delimiter))
    columns = []
    for j, (attribute, field) in enumerate(zip(schema.attributes, schema.struct_type(), strict=True)):
        text = trimmed(F.get(parts, F.lit(j)))
        if attribute.kind == "numeric":
            text = text.cast("double") if on_error == "fail" else text.try_cast("double")
        elif on_error == "fail" and attribute.labels:
            # within the column itself, so that no plan that reads the label can leave it out
            unknown = F.raise_error(F.concat(F.lit(f"undeclared label of {attribute.name}: "), text))
            text = F.when(_declared(attribute, text), text).otherwise(unknown)
        columns.append(text.alias(attribute.name, metadata=field.metadata))
    return lines.select("value", *columns)


def _known(schema: KeelSchema) -> Column:
    """True when all numbers were readable and all labels are declared or numbers."""
    good = F.lit(True)
    for a in schema.attributes:
        c = F.col(a.name)
        good = good & (_declared(a, c) if a.labels else c.isNotNull())
    return good


def read_keel(
    spark: SparkSession,
    schema: KeelSchema,
    path: str | Sequence[str],
    delimiter: str = ",",
    on_error: str = "fail",
    observation: Observation | None = None,
) -> DataFrame:
    """The data file as typed columns: DOUBLE for numbers, STRING for labels.

    Empty lines, ``@`` lines and lines with too few or too many fields are left
    out. A value that is no number, and a label that is neither declared nor a number
    (for the class: nor a code), stops the job, or with ``on_error='reject'`` leaves
    out its row; ``read_keel_rejects`` lists both. ``observation`` receives, with the
    first job that reads the table, ``num_lines`` and ``num_rejected``: data lines, and
    those of them left out. Splits follow ``spark.sql.files.maxPartitionBytes`` and
    ``minPartitionNum``.
    """
    if on_error not in ("fail", "reject"):
        raise ValueError("on_error must be 'fail' or 'reject'")
    width = len(schema.attributes)
    lines = spark.read.text(path).where(~_is_directive(F.col("value")))
    if observation is None and on_error == "fail":
        return _parsed(well_formed(lines, width, delimiter), schema, delimiter, on_error).drop("value")
    flagged = _parsed(lines, schema, delimiter, "reject")
    good = _fits(F.col("value"), width, delimiter)
    good = good & _known(schema) if on_error == "reject" else good
    flagged = lines.select("value", F.lit(True).alias("_line")) if on_error == "fail" else flagged
    marked = flagged.withColumn("_good", good)
    if observation is not None:
        marked = marked.observe(
            observation, F.count(F.lit(1)).alias("num_lines"), F.count_if(~F.col("_good")).alias("num_rejected")
        )
    kept = marked.where("_good")
    if on_error == "fail":
        kept = _parsed(kept, schema, delimiter, on_error)
    return kept.select(*[F.col(f"`{c}`") for c in schema.columns])


def read_keel_rejects(
    spark: SparkSession, schema: KeelSchema, path: str | Sequence[str], delimiter: str = ","
) -> DataFrame:
    """(value, reason) for the data lines ``on_error='reject'`` leaves out."""
    lines, width = spark.read.text(path), len(schema.attributes)
    short = rejects(lines, width, delimiter).select("value", F.lit("fields").alias("reason"))
    parsed = _parsed(well_formed(lines, width, delimiter), schema, delimiter, "reject")
    unread = parsed.where(~_known(schema)).select("value", F.lit("value").alias("reason"))
    return short.unionByName(unread)


def format_rows(df: DataFrame, columns: Sequence[str] | None = None, delimiter: str = ", ") -> DataFrame:
    """Rows as one delimited text column; vectors are spread out, nulls are empty."""
    parts = []
    for c in columns or df.columns:
        if df.schema[c].dataType.typeName() == "array":
            items = F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("")))
            parts.append(F.array_join(items, delimiter))
        else:
            parts.append(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return df.select(F.concat_ws(delimiter, *parts).alias("value"))


def write_balanced(
    df: DataFrame,
    path: str,
    format: str = "text",
    columns: Sequence[str] | None = None,
    delimiter: str = ", ",
    compression: str | None = "gzip",
    mode: str = "overwrite",
) -> None:
    """Write the table, by default as gzip text, replacing what is at ``path``."""
    if format == "text":
        out = format_rows(df, columns, delimiter)
    else:
        out = df.select(*columns) if columns else df
    writer = out.write.mode(mode)
    if compression and format in ("text", "csv", "json", "parquet", "orc"):
        writer = writer.option("compression", "zlib" if (format, compression) == ("orc", "gzip") else compression)
    writer.format(format).save(path)
