"""Chat formatting: records of several layouts become turns, and turns one marked text.

A record is a row of nested columns. The paths of its fields that hold a value are
joined in order and hashed; the hash picks the declared layout that has exactly
these paths, and the layout's mapping gives the turns. A record of an unknown
make-up keeps null turns and its fingerprint.

Template of a turn: ``### <role>: <text></turn>`` and a line feed. In roles and
texts a backslash goes before every backslash, and into every ``##`` and ``</turn``;
a role also escapes its colons. So the marks occur only as marks, and taking each
backslash away gives the text back.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "### ", "</turn>\n"
LOSS_ROLE = "assistant"


@dataclass(frozen=True)
class Layout:
    """A make-up of records: required and optional leaf paths, and what gives the turns.

    ``turns`` lists (role, path) pairs, or is one triple (array, role field, text field).
    """

    name: str
    required: tuple[str, ...]
    turns: tuple
    optional: tuple[str, ...] = field(default=())

    def fingerprints(self) -> list[str]:
        out = []
        for n in range(len(self.optional) + 1):
            for more in combinations(self.optional, n):
                out.append(hashlib.sha256("\n".join(sorted(self.required + more)).encode()).hexdigest())
        return out

    def column(self) -> Column:
        if isinstance(self.turns[0], str):
            array, role, text = self.turns
            return F.transform(array, lambda m: _turn(m[role], m[text]))
        parts = [F.when(F.col(p).isNotNull(), _turn(F.lit(r), F.col(p))) for r, p in self.turns]
        return F.filter(F.array(*parts), lambda t: t.isNotNull())


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), ("messages", "role", "content")),
    Layout("prompt", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Layout(
        "instruction",
        ("instruction", "output"),
        (("system", "instruction"), ("user", "input"), ("assistant", "output")),
        ("input",),
    ),
)


def paths(record: DataFrame, columns: list[str]) -> Column:
    """Array of the leaf paths that hold a value, in order; ``[]`` marks an array."""

    def some(value: Column, name: str) -> Column:
        return F.exists(value, lambda x: x[name].isNotNull())

    def walk(kind: T.DataType, value: Column, name: str) -> list[tuple[str, Column]]:
        if isinstance(kind, T.StructType):
            return [leaf for f in kind.fields for leaf in walk(f.dataType, value[f.name], f"{name}.{f.name}")]
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return [(f"{name}[].{f.name}", some(value, f.name)) for f in kind.elementType.fields]
        return [(name, value.isNotNull())]

    leaves = [leaf for c in columns for leaf in walk(record.schema[c].dataType, F.col(f"`{c}`"), c)]
    named = [F.when(F.coalesce(there, F.lit(False)), F.lit(name)) for name, there in sorted(leaves, key=lambda x: x[0])]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def canonical(records: DataFrame, columns: list[str], layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` plus fingerprint (hex), layout (name or null) and turns (array of role, text)."""
    marked = records.withColumn("fingerprint", F.sha2(F.array_join(paths(records, columns), "\n"), 256))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for x in layouts:
        if all(p.split("[")[0].split(".")[0] in columns for p in x.required + x.optional):
            known = F.col("fingerprint").isin(x.fingerprints())
            layout, turns = F.when(known, x.name).otherwise(layout), F.when(known, x.column()).otherwise(turns)
    return marked.withColumns({"layout": layout, "turns": turns})


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit("##"), F.lit("#\\#")), F.lit("</turn"), F.lit("<\\/turn"))
    return F.replace(out, F.lit(":"), F.lit("\\:")) if role else out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?s:(.))", "$1")


def render(turns: Column) -> tuple[Column, Column]:
    """The formatted text, and the loss mask: for each turn how many code points are
    before, under and after the mask (they add up to the whole text)."""
    parts = F.transform(
        turns, lambda t: F.struct(F.concat(F.lit(OPEN), escape(t["role"], True), F.lit(": ")).alias("head"), escape(t["text"]).alias("body"), t["role"].alias("role"))
    )
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")

    def run(p: Column) -> Column:
        learn = p["role"] == LOSS_ROLE
        size = F.length(p["head"]) + F.length(p["body"])
        return F.struct(
            F.when(learn, F.length(p["head"])).otherwise(size).alias("before"),
            F.when(learn, F.length(p["body"])).otherwise(0).alias("under"),
            F.lit(len(CLOSE)).alias("after"),
        )

    return text, F.transform(parts, run)


def format_chats(records: DataFrame, columns: list[str], layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``canonical`` plus formatted (text) and loss_mask; both null for an unknown layout.

    Null roles and texts inside a known layout count as empty. No turns give the
    empty text. Columns of ``records`` with the five names are replaced.
    """
    kept = records.drop("fingerprint", "layout", "turns", "formatted", "loss_mask")
    text, mask = render(F.col("turns"))
    return canonical(kept, columns, layouts).withColumns({"formatted": text, "loss_mask": mask})


def _turn_texts(formatted: Column) -> Column:
    """The turns of a formatted text, without the closing mark."""
    return F.filter(F.split(formatted, CLOSE), lambda x: x != "")


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) read back from a formatted text."""
    head = r"^### ((?:[^\\:]++|\\(?s:.))*+): (?s:(.*))$"
    return F.transform(
        _turn_texts(formatted),
        lambda x: F.struct(
            unescape(F.regexp_extract(x, head, 1)).alias("role"), unescape(F.regexp_extract(x, head, 2)).alias("text")
        ),
    )


def read_loss(formatted: Column, mask: Column) -> Column:
    """Everything under the loss mask, unescaped, in order."""
    under = F.zip_with(_turn_texts(formatted), mask, lambda x, m: F.substr(x, m["before"] + 1, m["under"]))
    return F.array_join(F.transform(under, unescape), "")
