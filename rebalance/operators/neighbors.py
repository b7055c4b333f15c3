"""Exact k nearest neighbours as a partitioned Spark join.

No cross join and no row per pair. A corpus of one block, of measured size, is sent to
the tasks that hold the queries, which stay where they are. A larger corpus is cut
into space cells, and cells into blocks of bounded size. Every distinct query vector is
first compared with the block it falls into, which bounds its k-th distance. Queries of
one block form chunks; a chunk meets just those other blocks that may hold something
within the bound of one of its queries, by their bounding boxes and by the triangle
inequality over a pivot and a radius for each cell. The routing table names chunks and
blocks alone. A task compares one chunk with one block and emits at most k rows per query.

In the larger search equal vectors cost one search: a query vector is searched once
however many rows hold it, and of equal candidates only the k with the lowest ids can
ever be neighbours. Partial results are merged by a point key of their own, so ids may
repeat.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebalance.functions.vectors import check_metric, not_finite
from rebalance.operators import blocks as B
from rebalance.operators.ranking import ROW_BITS
from rebalance.staging import stage, stage_observed

BLOCK_VALUES = 1 << 22  # doubles in one block of candidates (32 MiB)
BLOCK_ROWS = 65536
QUERY_ROWS = 8192  # queries that meet a block in one task
MIN_QUERY_ROWS = 512  # fewer are not worth a task of their own
MEETINGS_PER_TASK = 8  # where there are far more meetings than cores
TREE_VALUES = 1 << 21  # doubles in the cell boxes and in the sample they come from
HOT_ROWS = 100_000  # below this many rows no vector is worth salting
BROADCAST_VALUES = 1 << 22  # doubles in the neighbour lists of hot vectors


def topk_per_key(
    df: DataFrame, key: str | Sequence[str], order_by: Sequence[Column | str], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key. Each task drops what it can before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def merge_topk(*partial: DataFrame, k: int) -> DataFrame:
    """The k nearest of several partial lists (id, nbr_id, dist) per query.

    An entry that several lists hold counts once.
    """
    both = partial[0].drop("rank")
    for other in partial[1:]:
        both = both.unionByName(other.drop("rank"))
    # equal entries share a rank, and one of them stays; both steps use one exchange by id
    place = F.dense_rank().over(Window.partitionBy("id").orderBy("dist", "nbr_id"))
    first = both.withColumn("rank", place).where(F.col("rank") <= k).dropDuplicates(["id", "rank"])
    return first.select("id", "rank", "nbr_id", "dist")


@dataclass(frozen=True)
class _Search:
    k: int
    metric: str
    exclude_zero: bool
    with_vectors: bool

    def query_rows(self, width: int) -> int:
        """Queries per task, so that neither they nor their lists outgrow a block."""
        values = width * (self.k if self.with_vectors else 1)
        return max(64, min(QUERY_ROWS, BLOCK_VALUES // values))

    @property
    def list_type(self) -> str:
        vec = ", nbr_vec: array<double>" if self.with_vectors else ""
        return f"array<struct<dist: double, nbr_id: bigint{vec}>>"


def _prepared(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    if df.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be an integer column")
    return df.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")
    )


def _checked(df: DataFrame, name: str, written: bool) -> tuple[DataFrame, dict]:
    """Rows (id, vec), written unless they are already, with their number and the width of the vectors."""
    numbers = {
        "n": F.count(F.lit(1)),
        "width": F.max(F.size("vec")),
        "least_width": F.min(F.size("vec")),
        "bad": F.count_if(F.col("id").isNull() | F.col("vec").isNull() | F.exists("vec", not_finite)),
    }
    staged = df.select("id", "vec")
    if written:
        seen = staged.agg(*[c.alias(n) for n, c in numbers.items()]).first().asDict()
    else:
        staged, seen = stage_observed(staged, name, **numbers)
    if seen["bad"]:
        raise ValueError("null ids and null, NaN or infinite features cannot be compared")
    if seen["width"] != seen["least_width"]:
        raise ValueError("feature vectors differ in length")
    return staged, seen


def _distinct_points(rows: DataFrame, copies: int, name: str) -> tuple[DataFrame, dict]:
    """(key, id, vec, copy): rows with the ``copies`` lowest ids of every vector, written once.

    ``key`` numbers the points; it is fixed by the writing, and unlike the id never repeats.
    """
    points = topk_per_key(
        rows.withColumn("h", F.xxhash64("vec")), ["h", "vec"], ["id"], copies, rank="copy"
    )
    keyed = points.select(F.monotonically_increasing_id().alias("key"), "id", "vec", "copy")
    return stage_observed(keyed, name, n=F.count(F.lit(1)), n_distinct=F.count_if(F.col("copy") == 1))


def _search_in_place(queries: DataFrame, n_queries: int, corpus: DataFrame, width: int, search: _Search):
    """(id, vec, nbrs) for every query row, against a corpus of one block.

    The block, at most ``BLOCK_VALUES`` numbers by count, goes to the tasks; queries do
    not move, unless they fill far fewer tasks than their number is worth.
    """
    ids, vecs = B.block(corpus.select("id", "vec").toArrow(), "id", "vec")
    parts = B.leaves(vecs)
    k, metric, exclude_zero, with_vectors = search.k, search.metric, search.exclude_zero, search.with_vectors
    step = search.query_rows(width)

    def compare(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                some = batch.slice(start, step)
                x, back = B.distinct_rows(B.matrix(some.column("vec")))
                rows, cols, dist = B.nearest(x, vecs, ids, k, metric, exclude_zero, None, parts)
                found = B.neighbor_lists(len(x), rows, cols, dist, vecs, ids, with_vectors)
                columns = [some.column("id"), some.column("vec"), found.take(pa.array(back))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "vec", "nbrs"])

    spark = queries.sparkSession
    worth = min(2 * spark.sparkContext.defaultParallelism, math.ceil(n_queries / MIN_QUERY_ROWS))
    rows = queries.select("id", "vec")
    if 2 * rows.rdd.getNumPartitions() < worth:
        rows = rows.repartition(worth)
    return rows.mapInArrow(compare, f"id bigint, vec array<double>, nbrs {search.list_type}")


def _tasks(spark, meetings: int) -> int:
    """Partitions for so many meetings of bounded size: few share a task."""
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(1, min(meetings, max(2 * wanted, meetings // MEETINGS_PER_TASK)))


def _meet(queries: DataFrame, corpus: DataFrame, tasks: int, search: _Search) -> DataFrame:
    """Compare queries (meeting, key, id, vec, block | bound) with candidates (meeting, id, vec).

    Without a bound, every query gets a row with its list and the bound it gives; with
    one, queries that found something get a row (key, nbrs).
    """
    bounded = "bound" in queries.columns
    k, metric, exclude_zero, with_vectors = search.k, search.metric, search.exclude_zero, search.with_vectors

    def compare(q: pa.Table, c: pa.Table) -> pa.Table:
        # a side without rows comes without columns
        keys, x = B.block(q, "key", "vec")
        y_ids, y = B.block(c, "c_id", "c_vec")
        limit = q["bound"].to_numpy() if bounded and len(x) else None
        rows, cols, dist = B.nearest(x, y, y_ids, k, metric, exclude_zero, limit)
        nbrs = B.neighbor_lists(len(x), rows, cols, dist, y, y_ids, with_vectors)
        if bounded:
            some = pa.array(np.unique(rows))
            return pa.table({"key": pa.array(keys).take(some), "nbrs": nbrs.take(some)})
        out = {"key": pa.array(keys)}
        for name, kind in (("id", pa.int64()), ("block", pa.int64()), ("meeting", pa.int64())):
            out[name] = q[name] if len(x) else pa.array([], kind)
        out["vec"] = B.vectors(x)
        out["bound"] = pa.array(B.kth_distance(len(x), rows, dist, k))
        out["nbrs"] = nbrs
        return pa.table(out)

    home = "" if bounded else "id bigint, block bigint, meeting bigint, vec array<double>, bound double, "


    def place(meeting: str) -> Column:
        # numbers 0, 1, ... or generated ids; either way neighbours go to different tasks
        row = F.col(meeting).bitwiseAND((1 << ROW_BITS) - 1)
        return F.pmod(F.shiftright(meeting, ROW_BITS) * 7919 + row, F.lit(tasks)).cast("int")

    left = queries.repartitionById(tasks, place("meeting")).groupBy("meeting")
    # names of their own: both sides may stem from one table
    c_cols = [F.col(c).alias(f"c_{c}") for c in ("meeting", "id", "vec")]
    right = corpus.select(*c_cols).repartitionById(tasks, place("c_meeting")).groupBy("c_meeting")
    return left.cogroup(right).applyInArrow(compare, f"key bigint, {home}nbrs {search.list_type}")


def _cut_into_cells(corpus: DataFrame, n: int, width: int, cells: int):
    """The corpus with a cell number, and the split tree behind it.

    Just the split points come from a sample, of bounded size; every row is kept.
    """
    sample_rows = max(cells, min(64 * cells, (2 * TREE_VALUES) // width))
    share = min(1.0, sample_rows / n)
    pick = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = B.matrix(corpus.where(pick).select("vec").toArrow()["vec"])
    tree = B.split_tree(sample, cells) if len(sample) else None

    def assign(points: DataFrame) -> DataFrame:
        if tree is None:
            return points.withColumn("cell", F.lit(0))

        @F.arrow_udf("int")
        def cell_of(vec: pa.Array) -> pa.Array:
            return pa.array(B.leaf_of(tree, B.matrix(vec)))

        return points.withColumn("cell", cell_of("vec"))

    # rows of a cell are written together; AQE splits or joins uneven partitions
    return stage(assign(corpus).hint("rebalance", "cell"), "cells"), assign


@dataclass(frozen=True)
class _Cells:
    """Size, bounding box, pivot and radius of every cell; some ``TREE_VALUES`` numbers."""

    ids: np.ndarray
    sizes: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    pivots: np.ndarray
    radii: np.ndarray

    @staticmethod
    def of(corpus: DataFrame, metric: str) -> _Cells:
        rows = corpus.select("cell", "vec").mapInArrow(
            B.cell_parts, "cell int, n bigint, lo array<double>, hi array<double>, total array<double>"
        )
        merged = rows.groupBy("cell").applyInArrow(
            B.cell_merged, "cell int, n bigint, lo array<double>, hi array<double>, total array<double>"
        )
        got = merged.toArrow().sort_by("cell")
        ids, sizes = got["cell"].to_numpy(), got["n"].to_numpy()
        lo, hi, total = (B.matrix(got[c]) for c in ("lo", "hi", "total"))
        with np.errstate(over="ignore", invalid="ignore"):
            pivots = total / sizes[:, None]
        pivots = np.where(np.isfinite(pivots), np.clip(pivots, lo, hi), lo)
        far = corpus.select("cell", "vec").mapInArrow(B.far_rows(ids, pivots, metric), "cell int, far double")
        by_cell = dict(far.groupBy("cell").agg(F.max("far")).collect())
        return _Cells(ids, sizes, lo, hi, pivots, np.array([by_cell[c] for c in ids.tolist()]))


def _search_lists(queries: DataFrame, n_queries: int, corpus: DataFrame, n: int, width: int, cells: int, search: _Search):
    """(id, vec, nbrs) for every query; ``queries`` and ``corpus`` are staged points."""
    spark = queries.sparkSession
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_VALUES // width))
    query_rows = search.query_rows(width)
    corpus = corpus.select("key", "id", "vec")
    queries = queries.select("key", "id", "vec")
    if cells == 1:
        corpus, queries = corpus.withColumn("cell", F.lit(0)), queries.withColumn("cell", F.lit(0))
    else:
        corpus, assign = _cut_into_cells(corpus, n, width, cells)
        queries = assign(queries)
    cut = _Cells.of(corpus, search.metric)
    n_subs = np.ceil(cut.sizes / block_rows).astype(np.int64)
    firsts = np.cumsum(n_subs) - n_subs
    n_blocks = int(n_subs.sum())
    # one row for each cell
    layout = spark.createDataFrame(pa.table({"at": pa.array(cut.ids), "subs": pa.array(n_subs), "first": pa.array(firsts)}))

    def in_blocks(points: DataFrame) -> DataFrame:
        block = F.col("first") + F.pmod(F.xxhash64("key"), F.col("subs"))
        return points.join(F.broadcast(layout), F.col("cell") == F.col("at"), "left").select(
            "key", "id", "vec", F.coalesce(block, F.lit(0).cast("bigint")).alias("block")
        )

    corpus, queries = in_blocks(corpus), in_blocks(queries)

    # first meeting: a chunk of the queries of a block with that block
    counts = queries.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / query_rows).alias("chunks"))
    before = Window.partitionBy(F.lit(1)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    chunks = stage(counts.withColumn("start", F.coalesce(F.sum("chunks").over(before), F.lit(0))), "chunks")
    chunk = F.col("start") + F.pmod(F.xxhash64("key", F.lit(7)), "chunks")
    left = queries.join(chunks, "block").select("key", "id", "vec", "block", chunk.alias("meeting"))
    every = F.sequence(F.col("start"), F.col("start") + F.col("chunks") - 1)
    right = corpus.join(chunks, "block").select("id", "vec", F.explode(every).alias("meeting"))
    tasks = _tasks(spark, n_blocks + math.ceil(n_queries / query_rows))
    met = stage(_meet(left, right, tasks, search).withColumnRenamed("meeting", "chunk"), "met")
    metric, cell_of_block = search.metric, np.repeat(np.arange(len(n_subs)), n_subs)
    lo, hi, pivots, radii = cut.lo, cut.hi, cut.pivots, cut.radii

    def route(batches):
        for batch in batches:
            x, bound = B.matrix(batch["vec"]), batch["bound"].to_numpy()
            own, of = batch["block"].to_numpy(), batch["chunk"].to_numpy()
            home, found = cell_of_block[own], []
            for rows, at in B.cells_in_reach(x, bound, home, lo, hi, pivots, radii, metric):
                times = n_subs[at]
                rows, at = np.repeat(rows, times), np.repeat(at, times)
                block = firsts[at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                away = block != own[rows]
                found.append(np.unique(of[rows[away]] * n_blocks + block[away]))
            pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"to": pa.array(pairs // n_blocks), "visited": pa.array(pairs % n_blocks)})

    # chunks and blocks by number; no vector is written for a visit
    routed = met.select("chunk", "block", "vec", "bound").mapInArrow(route, "to bigint, visited bigint").distinct()
    routes, seen = stage_observed(
        routed.withColumn("meeting", F.monotonically_increasing_id()), "routes", n=F.count(F.lit(1))
    )
    if not seen["n"]:
        return met.select("id", "vec", "nbrs")
    visitors = met.join(routes, F.col("chunk") == F.col("to")).select("meeting", "key", "vec", "bound")
    hosts = corpus.join(routes, F.col("block") == F.col("visited")).select("meeting", "id", "vec")
    more = _meet(visitors, hosts, _tasks(spark, seen["n"]), search)
    # what the visits add, k entries per query at most; queries that need none stay put
    added = (
        topk_per_key(
            more.select("key", F.explode("nbrs").alias("nbr")), "key", ["nbr.dist", "nbr.nbr_id"], search.k
        )
        .groupBy("key")
        .agg(F.collect_list("nbr").alias("added"))
    )
    best = F.slice(F.sort_array(F.concat("nbrs", "added")), 1, search.k)
    return met.join(added, "key", "left").select(
        "id", "vec", F.when(F.col("added").isNull(), F.col("nbrs")).otherwise(best).alias("nbrs")
    )


def _attach(rows: DataFrame, n_rows: int, lists: DataFrame, per_list: int) -> DataFrame:
    """Give every row (id, vec) the list found for its vector.

    A vector held by very many rows would send them all to one task, so the
    few such vectors are joined by broadcast. There are at most ``limit`` of
    them, because each holds more than ``n_rows / limit`` rows.
    """
    lists = lists.withColumn("h", F.xxhash64("vec"))
    rows = rows.withColumn("h", F.xxhash64("vec"))

    def joined(r: DataFrame, x: DataFrame) -> DataFrame:
        x = x.select(F.col("h").alias("lh"), F.col("vec").alias("lvec"), "nbrs")
        return r.join(x, (r.h == x.lh) & (r.vec == x.lvec), "left").select("id", "vec", "nbrs")

    if n_rows <= HOT_ROWS:
        return joined(rows, lists)
    limit = max(1, min(1000, BROADCAST_VALUES // per_list))
    hot = [
        r.h
        for r in rows.groupBy("h").count().where(F.col("count") > n_rows // limit).select("h").collect()
    ]
    if not hot:
        return joined(rows, lists)
    is_hot = F.col("h").isin(hot)
    return joined(rows.where(is_hot), F.broadcast(lists.where(is_hot))).unionByName(
        joined(rows.where(~is_hot), lists.where(~is_hot))
    )


def neighbor_lists(
    queries: DataFrame,
    corpus: DataFrame | None = None,
    k: int = 5,
    metric: str = "euclidean",
    *,
    exclude_zero: bool = True,
    blocks: int | None = None,
    with_vectors: bool = False,
    written: bool = False,
) -> DataFrame:
    """(id, vec, nbrs) per query row; inputs are (id, vec), no corpus means self.

    ``written`` tells that the inputs are plain reads of tables and need no writing here.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if blocks is not None and blocks < 1:
        raise ValueError("blocks must be at least 1")
    search = _Search(k, check_metric(metric), exclude_zero, with_vectors)
    rows, seen = _checked(queries if corpus is None else corpus, "rows", written)
    asking, n_rows = rows, seen["n"]
    if corpus is not None:
        asking, of_queries = _checked(queries, "queries", written)
        n_rows = of_queries["n"]
        if n_rows and seen["n"] and of_queries["width"] != seen["width"]:
            raise ValueError("feature vectors differ in length")
    if not seen["n"] or not n_rows:
        return queries.withColumn("nbrs", F.lit(None).cast(search.list_type.replace(": ", ":")))
    n, width = seen["n"], max(1, seen["width"])
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_VALUES // width))
    if n <= block_rows and (blocks or 1) == 1:
        return _search_in_place(asking, n_rows, rows, width, search)

    points, of_points = _distinct_points(rows, k, "points")
    firsts, n = points.where(F.col("copy") == 1), of_points["n"]
    n_firsts = of_points["n_distinct"]
    if corpus is not None:
        firsts, of_queries = _distinct_points(asking, 1, "queries")
        n_firsts = of_queries["n"]
    most = max(1, TREE_VALUES // width)
    cells = min(math.ceil(n / block_rows), most)
    if cells > 1 and width <= 16:
        # small cells prune well where dimensions are few
        cells = min(4 * cells, most)
    if blocks is not None:
        # fewer cells than the size asks for would each meet a growing part of the rows
        cells = min(max(blocks, cells), most, n)
    lists = _search_lists(firsts, n_firsts, points, n, width, cells, search)
    if n_rows == n_firsts:
        return lists.select("id", "vec", "nbrs")  # no vector occurs twice
    return _attach(asking, n_rows, lists, width + k * (2 + (width if with_vectors else 0)))


def _long(lists: DataFrame) -> DataFrame:
    return lists.select("id", F.posexplode("nbrs").alias("pos", "nbr")).select(
        "id", (F.col("pos") + 1).alias("rank"), "nbr.*"
    )


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    metric: str = "euclidean",
    *,
    id_col: str = "id",
    vec_col: str = "features",
    exclude_zero: bool = True,
    blocks: int | None = None,
    with_vectors: bool = False,
) -> DataFrame:
    """The exact k nearest corpus rows of every query row.

    Returns (id, rank, nbr_id, dist[, nbr_vec]), ranked by distance, then id.
    ``exclude_zero`` leaves out rows at distance zero, so a row is neither its
    own neighbour nor that of an exact copy. ``blocks`` asks for a number of
    space cells, of which a large corpus gets more; the result does not depend on it.
    """
    return _long(
        neighbor_lists(
            _prepared(queries, id_col, vec_col),
            _prepared(corpus, id_col, vec_col),
            k,
            metric,
            exclude_zero=exclude_zero,
            blocks=blocks,
            with_vectors=with_vectors,
        )
    )


def knn_self(
    df: DataFrame,
    k: int = 5,
    metric: str = "euclidean",
    *,
    id_col: str = "id",
    vec_col: str = "features",
    blocks: int | None = None,
    with_vectors: bool = False,
) -> DataFrame:
    """``knn_join`` of a table with itself."""
    return _long(
        neighbor_lists(
            _prepared(df, id_col, vec_col), None, k, metric, blocks=blocks, with_vectors=with_vectors
        )
    )
