"""Numpy helpers that Spark tasks run for the ranges of a vector column.

Every task sums up its rows in one row: counts, and the least and largest item at every
position. Some ``MERGERS`` tasks put these rows together, and one reads what is left.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Workers get these helpers with the task, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PARTS = "bucket int, n bigint, n_pos bigint, bad bigint, sizes array<bigint>, lo array<double>, hi array<double>"
MERGERS = 64  # rows that are left of any number of tasks


def wider(old: np.ndarray, width: int, fill: float) -> np.ndarray:
    return np.concatenate([old, np.full(max(0, width - len(old)), fill, old.dtype)])


def ends_of(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, least and largest item at every position; NaN is the largest.

    Where all items are null, the least is above the largest.
    """
    items = lists.flatten()
    values = items.to_numpy(zero_copy_only=False)
    present = items.is_valid().to_numpy(zero_copy_only=False)
    widths = pc.list_value_length(lists).drop_null().to_numpy()
    width = int(widths.max(initial=0))
    low, high = np.where(present, values, np.inf), np.where(present, values, -np.inf)
    if len(widths) and widths.min() == width:
        shape = (len(widths), width)
        return (
            np.full(width, len(widths)),
            np.fmin.reduce(low.reshape(shape), axis=0),
            np.maximum.reduce(high.reshape(shape), axis=0),
        )
    at = np.arange(len(values)) - np.repeat(np.cumsum(widths) - widths, widths)
    least, most = np.full(width, np.inf), np.full(width, -np.inf)
    np.fmin.at(least, at, low)
    np.maximum.at(most, at, high)
    return np.bincount(at, minlength=width), least, most


class Parts:
    """Sums over the rows seen so far."""

    def __init__(self):
        self.n = self.n_pos = self.bad = 0
        self.sizes, self.lo, self.hi = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def add(self, n: int, n_pos: int, bad: int, sizes, lo, hi) -> None:
        width = max(len(self.sizes), len(sizes))
        self.n, self.n_pos, self.bad = self.n + n, self.n_pos + n_pos, self.bad + bad
        self.sizes = wider(self.sizes, width, 0) + wider(np.asarray(sizes, np.int64), width, 0)
        self.lo = np.fmin(wider(self.lo, width, np.inf), wider(lo, width, np.inf))
        self.hi = np.maximum(wider(self.hi, width, -np.inf), wider(hi, width, -np.inf))

    def row(self, bucket: int) -> pa.Table:
        one = lambda x, kind: pa.array([x.tolist()], pa.list_(kind))
        return pa.table(
            {
                "bucket": pa.array([bucket], pa.int32()),
                "n": [self.n],
                "n_pos": [self.n_pos],
                "bad": [self.bad],
                "sizes": one(self.sizes, pa.int64()),
                "lo": one(self.lo, pa.float64()),
                "hi": one(self.hi, pa.float64()),
            }
        )


def task_parts(batches):
    """One row for all rows (vec, positive) of a task."""
    from pyspark import TaskContext

    seen = Parts()
    for batch in batches:
        vec = batch.column("vec")
        sizes, lo, hi = ends_of(vec)
        items = vec.flatten()
        finite = pc.sum(pc.fill_null(pc.is_finite(items), False)).as_py() or 0
        positive = pc.sum(pc.fill_null(batch.column("positive"), False)).as_py() or 0
        seen.add(batch.num_rows, positive, len(items) - finite + vec.null_count, sizes, lo, hi)
    yield from seen.row(TaskContext.get().partitionId() % MERGERS).to_batches()


def merged(rows: pa.Table) -> Parts:
    seen = Parts()
    for r in rows.to_pylist():
        seen.add(r["n"], r["n_pos"], r["bad"], r["sizes"], np.array(r["lo"], float), np.array(r["hi"], float))
    return seen
