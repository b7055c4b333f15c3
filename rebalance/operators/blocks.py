"""Numpy helpers that Spark tasks run on one bounded block of rows.

``split_tree`` and ``leaf_of`` cut the feature space into cells, ``box_gap``
gives a lower bound for the distance to a cell, ``nearest`` compares one block
of queries with one block of candidates. Distances are added up dimension by
dimension, left to right, and only monotone operations follow, so the bound
of a cell never exceeds the computed distance of a row inside it.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Workers get these helpers with the task, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TILE = 1 << 16  # distances held at a time
LEAF_ROWS = 512  # candidates that are compared or skipped together
NEAR_LEAVES = 8  # leaves that sharpen the bound before the others are judged
WIDE = 5  # vectors of this length and more are screened, by a matrix product or in coarse steps
COARSE = (1 << 15) - 1  # the largest distance in coarse steps
COARSE_LEVELS = 16  # fewer would screen too little


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as a 2-d array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def block(table: pa.Table, ids: str, vecs: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows one task got; possibly none."""
    if not table.num_rows:
        return np.zeros(0, dtype=np.int64), np.zeros((0, 1))
    return table[ids].to_numpy(), matrix(table[vecs])


def vectors(rows: np.ndarray) -> pa.ListArray:
    """A 2-d array as a list column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel()))


def split_tree(sample: np.ndarray, leaves: int) -> dict[str, np.ndarray]:
    """Halve the sample at the median of its widest dimension until there are
    ``leaves`` parts. Node i sends rows with ``x[dim] > cut`` right, others left."""
    dim, cut, left, right, depth = [-1], [0.0], [0], [0], [0]
    open_nodes = [(len(sample), 0, np.arange(len(sample)))]
    n_leaves = 1
    while open_nodes and n_leaves < leaves:
        following = []
        for _, node, rows in sorted(open_nodes, key=lambda t: (-t[0], t[1])):
            if n_leaves >= leaves or len(rows) < 2:
                continue
            part = sample[rows]
            d = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            values = part[:, d]
            middle = np.partition(values, (len(values) - 1) // 2)[(len(values) - 1) // 2]
            if middle == values.max():
                below = values[values < middle]
                if not len(below):
                    continue  # all rows alike
                middle = below.max()
            goes_right = values > middle
            children = []
            for side in (rows[~goes_right], rows[goes_right]):
                children.append(len(dim))
                following.append((len(side), len(dim), side))
                dim.append(-1)
                cut.append(0.0)
                left.append(0)
                right.append(0)
                depth.append(depth[node] + 1)
            dim[node], cut[node], (left[node], right[node]) = d, float(middle), children
            n_leaves += 1
        open_nodes = following
    dim = np.array(dim)
    leaf = np.cumsum(dim < 0) - 1
    return {
        "dim": dim,
        "cut": np.array(cut),
        "left": np.array(left),
        "right": np.array(right),
        "leaf": leaf,
        "depth": np.array(max(depth)),
    }


def leaf_of(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf number of every row."""
    node = np.zeros(len(x), dtype=np.int64)
    at = np.arange(len(x))
    for _ in range(int(tree["depth"])):
        d = tree["dim"][node]
        inner = d >= 0
        goes_right = x[at, np.where(inner, d, 0)] > tree["cut"][node]
        node = np.where(inner, np.where(goes_right, tree["right"][node], tree["left"][node]), node)
    return tree["leaf"][node].astype(np.int32)


def _distances(gap_of, dims: int, shape: tuple[int, int], metric: str) -> np.ndarray:
    total = np.zeros(shape)
    for j in range(dims):
        gap = gap_of(j)
        if metric == "manhattan":
            np.abs(gap, out=gap)
        else:
            np.multiply(gap, gap, out=gap)
        total += gap
    return np.sqrt(total, out=total) if metric == "euclidean" else total


def box_gap(qlo, qhi, lo, hi, metric: str) -> np.ndarray:
    """Least possible distance between boxes ``q`` (rows) and boxes (columns)."""

    def gap_of(j):
        return np.maximum(np.maximum(lo[:, j] - qhi[:, j, None], qlo[:, j, None] - hi[:, j]), 0.0)

    return _distances(gap_of, lo.shape[1], (len(qlo), len(lo)), metric)


def _first_k(rows, cols, dist, c_ids, k: int):
    """Sort found pairs by (query, distance, id) and keep k per query."""
    order = np.lexsort((c_ids[cols], dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep], dist[keep]


def _kth_smallest(values: np.ndarray, k: int) -> np.ndarray:
    if values.shape[1] <= k:
        return np.full(len(values), np.finfo(float).max)
    return np.partition(values, k - 1, axis=1)[:, k - 1]


def _all_pairs(part, columns, k, metric, exclude_zero, bound):
    """Pairs of a tile that can be among the k nearest, by their distance."""
    dims, n = columns.shape
    dist = _distances(lambda j: part[:, j, None] - columns[j], dims, (len(part), n), metric)
    if exclude_zero:
        dist[dist <= 0.0] = np.inf
    limit = np.minimum(_kth_smallest(dist, k), bound)
    rows, cols = np.nonzero(dist <= limit[:, None])
    return rows, cols, dist[rows, cols]


def _screened_pairs(part, columns, k, exclude_zero, bound):
    """The same for wide vectors: a matrix product screens the pairs.

    Its squared distances, taken around the middle of the block, are off by no
    more than ``slack``. What may belong to the k nearest is then computed as
    everywhere else.
    """
    middle = columns.mean(axis=1)
    p, c = part - middle, columns - middle[:, None]
    p2, c2 = (p * p).sum(axis=1), (c * c).sum(axis=0)
    slack = 16 * (len(c) + 8) * np.finfo(float).eps * (p2 + c2.max()) + 1e-300  # and of underflow
    rough = p @ c
    rough *= -2.0
    rough += p2[:, None]
    rough += c2
    with np.errstate(over="ignore"):
        limit = bound * bound * (1 + 1e-12)
    if np.isinf(limit).any():
        most = rough + slack[:, None]
        if exclude_zero:
            most[rough <= slack[:, None]] = np.inf  # may be zero: must not count as a neighbour
        limit = np.minimum(limit, _kth_smallest(most, k))
    rows, cols = np.nonzero(rough <= (limit + slack)[:, None])
    gaps = part[rows] - columns.T[cols]
    # accumulate adds from left to right, as _distances does
    dist = np.sqrt(np.add.accumulate(gaps * gaps, axis=1)[:, -1])
    good = (dist <= bound[rows]) & ((dist > 0.0) if exclude_zero else True)
    return rows[good], cols[good], dist[good]


def _coarse(q, c):
    """Both sides in whole steps of one size, for 16-bit distances, and that size; None if there is none."""
    levels = COARSE // c.shape[1]
    low = np.minimum(q.min(axis=0), c.min(axis=0))
    step = (np.maximum(q.max(axis=0), c.max(axis=0)) - low).max() / levels
    if levels < COARSE_LEVELS or step < 1e-100:
        return None
    return np.rint((q - low) / step).astype(np.int16), np.rint((c - low) / step).astype(np.int16).T.copy(), step


def _coarse_pairs(part, c, steps, columns, size, k, exclude_zero, bound):
    """The same for wide vectors by the manhattan distance: a distance in coarse steps screens the pairs.

    It is off by no more than one step for each dimension, and 0 for equal vectors. What
    may belong to the k nearest is then computed as everywhere else.
    """
    dims, n = columns.shape
    rough, gap = np.zeros((len(part), n), np.int16), np.empty((len(part), n), np.int16)
    for j in range(dims):
        np.subtract(steps[:, j, None], columns[j], out=gap)
        np.abs(gap, out=gap)
        rough += gap
    slack = dims * (1 + 1e-6)  # and for rounding
    with np.errstate(over="ignore"):
        limit = bound / size + slack
    if (limit >= COARSE).any():
        # an equal vector must not count as a neighbour
        most = np.where(rough == 0, np.int16(COARSE), rough) if exclude_zero else rough
        limit = np.minimum(limit, _kth_smallest(most, k) + 2 * slack)
    rows, cols = np.nonzero(rough <= np.minimum(limit, COARSE).astype(np.int16)[:, None])
    gaps = np.abs(part[rows] - c[cols])
    # accumulate adds from left to right, as _distances does
    dist = np.add.accumulate(gaps, axis=1)[:, -1]
    good = (dist <= bound[rows]) & ((dist > 0.0) if exclude_zero else True)
    return rows[good], cols[good], dist[good]


def _compare(q, c, c_ids, k, metric, exclude_zero, bound):
    """Compare all queries with all candidates, a tile at a time."""
    columns = np.ascontiguousarray(c.T)
    wide = (
        len(q) > 0
        and c.shape[1] >= WIDE
        and max(np.abs(q).max(initial=0.0), np.abs(c).max(initial=0.0)) < 1e100
    )
    screen = wide and metric == "euclidean"
    coarse = _coarse(q, c) if wide and metric == "manhattan" else None
    out = []
    step = max(1, TILE // len(c))
    for start in range(0, len(q), step):
        part, most = q[start : start + step], bound[start : start + step]
        if screen:
            rows, cols, dist = _screened_pairs(part, columns, k, exclude_zero, most)
        elif coarse:
            steps, theirs, size = coarse
            rows, cols, dist = _coarse_pairs(
                part, c, steps[start : start + step], theirs, size, k, exclude_zero, most
            )
        else:
            rows, cols, dist = _all_pairs(part, columns, k, metric, exclude_zero, most)
        rows, cols, dist = _first_k(rows, cols, dist, c_ids, k)
        out.append((rows + start, cols, dist))
    return _joined(out)


def _joined(parts):
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def leaves(c: np.ndarray):
    """The rows of every leaf of a block, with the leaves' boxes; None for a small block."""
    if len(c) <= 2 * LEAF_ROWS:
        return None
    leaf = leaf_of(split_tree(c, len(c) // LEAF_ROWS), c)
    order = np.argsort(leaf, kind="stable")
    starts = np.flatnonzero(np.diff(leaf[order], prepend=-1))
    lo, hi = np.minimum.reduceat(c[order], starts), np.maximum.reduceat(c[order], starts)
    return np.split(order, starts[1:]), lo, hi


def nearest(q, c, c_ids, k: int, metric: str, exclude_zero: bool, bound=None, parts=None):
    """The ``k`` nearest candidates of every query, ordered by (distance, id).

    Returns (query row, candidate row, distance), sorted by query and rank.
    ``bound`` leaves out candidates farther away than that, per query, and queries with
    no part of the block in reach are left out at once. A large block is cut into
    leaves (``parts``, if they are at hand), and a query skips those out of its reach.
    """
    if not len(q) or not len(c):
        return _joined([])
    far = np.full(len(q), np.finfo(float).max)
    limit = far if bound is None else np.minimum(bound, far)
    if bound is not None:
        whole = box_gap(q, q, c.min(axis=0)[None], c.max(axis=0)[None], metric)[:, 0]
        some = np.flatnonzero(whole <= limit)
        if len(some) < len(q):
            rows, cols, dist = nearest(q[some], c, c_ids, k, metric, exclude_zero, bound[some], parts)
            return some[rows], cols, dist
    parts = parts or leaves(c)
    if parts is None:
        return _compare(q, c, c_ids, k, metric, exclude_zero, limit)
    members, lo, hi = parts
    gaps = box_gap(q, q, lo, hi, metric)
    found = _joined([])
    # the nearest leaf, the next few, then all others that are still in reach
    for few in (1, NEAR_LEAVES, len(members)):
        picked = _nearest_columns(gaps, few)
        rows, slots = np.nonzero(np.take_along_axis(gaps, picked, axis=1) <= limit[:, None])
        nodes = picked[rows, slots]
        gaps[rows, nodes] = np.inf
        out = [found]
        for number, some in _by_value(nodes, rows):
            at = members[number]
            r, i, d = _compare(q[some], c[at], c_ids[at], k, metric, exclude_zero, limit[some])
            out.append((some[r], at[i], d))
        found = _first_k(*_joined(out), c_ids, k)
        limit = np.minimum(limit, kth_distance(len(q), found[0], found[2], k))
    return found


def distinct_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct vectors, and for every row the number of its vector."""
    x = np.ascontiguousarray(x + 0.0)  # -0.0 is 0.0
    _, first, back = np.unique(x.view(f"V{8 * x.shape[1]}")[:, 0], return_index=True, return_inverse=True)
    return x[first], back


def _nearest_columns(values: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n columns with the least values, per row."""
    if n >= values.shape[1]:
        return np.broadcast_to(np.arange(values.shape[1]), values.shape)
    return np.argpartition(values, n - 1, axis=1)[:, :n]


def _by_value(values: np.ndarray, rows: np.ndarray):
    """(value, its rows) for every value."""
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    starts = np.flatnonzero(np.diff(values, prepend=-1))
    return zip(values[starts], np.split(rows, starts[1:]), strict=bool(len(starts)))


def neighbor_lists(n_queries: int, rows, cols, dist, c, c_ids, with_vectors: bool) -> pa.ListArray:
    """One list of (dist, nbr_id[, nbr_vec]) per query, in rank order."""
    offsets = np.searchsorted(rows, np.arange(n_queries + 1)).astype(np.int32)
    fields = {"dist": pa.array(dist), "nbr_id": pa.array(c_ids[cols])}
    if with_vectors:
        fields["nbr_vec"] = vectors(c[cols])
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), list(fields))
    )


def kth_distance(n_queries: int, rows, dist, k: int) -> np.ndarray:
    """Distance of the k-th neighbour found so far, infinite when there are fewer."""
    ends = np.searchsorted(rows, np.arange(n_queries), side="right")
    counts = ends - np.searchsorted(rows, np.arange(n_queries))
    bound = np.full(n_queries, np.inf)
    full = counts >= k
    bound[full] = dist[ends[full] - 1]
    return bound


def cells_in_reach(x, bound, home, lo, hi, pivots, radii, metric: str):
    """(query row, cell) for every cell that may hold a row within the query's bound.

    A cell is out of reach by its box, or because the query is farther from the cell's
    pivot than its bound and the cell's radius together. That sum is widened by far
    more than distances can be rounded.
    """
    for cell in np.unique(home):
        rows = np.flatnonzero(home == cell)
        qlo, qhi = x[rows].min(axis=0)[None], x[rows].max(axis=0)[None]
        near = np.flatnonzero(box_gap(qlo, qhi, lo, hi, metric)[0] <= bound[rows].max())
        step = max(1, TILE // max(1, len(near)))
        for start in range(0, len(rows), step):
            some = rows[start : start + step]
            most = bound[some][:, None]
            inside = box_gap(x[some], x[some], lo[near], hi[near], metric) <= most
            with np.errstate(over="ignore", invalid="ignore"):
                away = box_gap(x[some], x[some], pivots[near], pivots[near], metric)
                slack = 1e-9 * (away + radii[near])
                inside &= ~(away - radii[near] > most + slack)
            r, c = np.nonzero(inside)
            yield some[r], near[c]


_CELL = ("cell", "n", "lo", "hi", "total")


def _summed_by(cell, n, lo, hi, total) -> pa.Table:
    """One row for each cell from rows of sizes, ends and sums."""
    order = np.argsort(cell, kind="stable")
    starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(total[order], starts)
    columns = [
        pa.array(cell[order][starts].astype(np.int32)),
        pa.array(np.add.reduceat(n[order], starts)),
        vectors(np.minimum.reduceat(lo[order], starts)),
        vectors(np.maximum.reduceat(hi[order], starts)),
        vectors(sums),
    ]
    return pa.table(dict(zip(_CELL, columns, strict=True)))


def cell_parts(batches):
    """Size, ends and sums of the cells of every batch of (cell, vec)."""
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column("vec"))
            one = np.ones(len(x), np.int64)
            yield from _summed_by(batch.column("cell").to_numpy(), one, x, x, x).to_batches()


def cell_merged(rows: pa.Table) -> pa.Table:
    """The parts of one cell put together; there is one for each batch that held the cell."""
    lo, hi, total = (matrix(rows[c]) for c in ("lo", "hi", "total"))
    return _summed_by(rows["cell"].to_numpy(), rows["n"].to_numpy(), lo, hi, total)


def far_rows(cell_ids: np.ndarray, pivots: np.ndarray, metric: str):
    """Largest distance from the pivot, for the cells of every batch of (cell, vec)."""

    def run(batches):
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            x, at = matrix(batch.column("vec")), np.searchsorted(cell_ids, cell)
            with np.errstate(over="ignore"):
                gaps = np.abs(x - pivots[at])
                far = gaps.sum(axis=1) if metric == "manhattan" else np.sqrt((gaps * gaps).sum(axis=1))
            most = np.zeros(len(cell_ids))
            np.maximum.at(most, at, far)
            some = np.unique(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell_ids[some].astype(np.int32)), pa.array(most[some])], names=["cell", "far"]
            )

    return run
