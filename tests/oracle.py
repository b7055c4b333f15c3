"""Run a query and its SQL twin, and compare names, types and all values."""

from __future__ import annotations

import glob
import os

import duckdb
import pyarrow as pa


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def rows(table: pa.Table) -> list[tuple]:
    table = table.select(sorted(table.column_names))
    values = [tuple(repr(v) for v in r) for r in zip(*[c.to_pylist() for c in table.columns], strict=True)]
    return sorted(values)


def kinds(table: pa.Table) -> dict[str, str]:
    def plain(t):
        t = str(t)
        return "string" if t in ("large_string", "string", "string_view") else t

    return {n: plain(table.schema.field(n).type) for n in sorted(table.column_names)}


def differences(ours: pa.Table, theirs: pa.Table) -> str | None:
    if kinds(ours) != kinds(theirs):
        return f"types {kinds(ours)} / {kinds(theirs)}"
    a, b = rows(ours), rows(theirs)
    if a != b:
        only_a, only_b = [r for r in a if r not in set(b)], [r for r in b if r not in set(a)]
        return f"{len(a)} / {len(b)} rows, e.g. {only_a[:3]} / {only_b[:3]}"
    return None
