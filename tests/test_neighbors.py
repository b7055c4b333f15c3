import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from rebalance.operators import blocks, neighbors


def brute(queries, corpus, k, metric="euclidean", exclude_zero=True):
    """All pairs, terms added left to right."""
    ids = np.array(sorted(corpus), dtype=np.int64)
    c = np.array([corpus[i] for i in ids])
    out = {}
    for q, x in queries.items():
        d = np.zeros(len(c))
        for j in range(c.shape[1]):
            gap = x[j] - c[:, j]
            d = d + (np.abs(gap) if metric == "manhattan" else gap * gap)
        d = np.sqrt(d) if metric == "euclidean" else d
        found = sorted((float(d[t]), int(ids[t])) for t in range(len(c)) if d[t] > 0 or not exclude_zero)
        out[q] = [(i, dist) for dist, i in found[:k]]
    return out


def frame(spark, points):
    rows = [(int(i), [float(v) for v in x]) for i, x in points.items()]
    return spark.createDataFrame(rows, "id bigint, features array<double>")


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.id, r["rank"])):
        out.setdefault(r.id, []).append((r.nbr_id, r.dist))
    return out


def points(n, dims, seed, grid=None):
    rng = np.random.default_rng(seed)
    x = rng.random((n, dims))
    if grid:
        x = np.round(x * grid) / grid
    return dict(zip(rng.permutation(10 * n)[:n].tolist(), x.tolist(), strict=True))


def same(got, want):
    return got == {q: found for q, found in want.items() if found}


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("blocks_asked", [None, 1, 6])
def test_self_join_is_exact_with_ties_and_copies(spark, metric, blocks_asked):
    p = points(300, 2, 1, grid=8)  # at most 81 distinct vectors
    got = lists(neighbors.knn_self(frame(spark, p), 4, metric, blocks=blocks_asked))
    assert same(got, brute(p, p, 4, metric))


@pytest.mark.parametrize("exclude_zero", [True, False])
@pytest.mark.parametrize("blocks_asked", [None, 5])
def test_join_of_two_tables(spark, exclude_zero, blocks_asked):
    p = points(200, 3, 2, grid=3)
    q = {i + 5000: x for i, x in itertools.islice(p.items(), 40)} | points(20, 3, 3)
    got = lists(neighbors.knn_join(frame(spark, q), frame(spark, p), 6, exclude_zero=exclude_zero, blocks=blocks_asked))
    assert same(got, brute(q, p, 6, exclude_zero=exclude_zero))


@pytest.mark.parametrize("blocks_asked", [None, 1, 7])
def test_bounded_blocks_and_chunks(spark, monkeypatch, blocks_asked):
    """Blocks of 16 candidates meet chunks of 8 queries."""
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbors, "QUERY_ROWS", 8)
    p = points(250, 2, 4)
    got = lists(neighbors.knn_self(frame(spark, p), 5, blocks=blocks_asked))
    assert same(got, brute(p, p, 5))


def test_wide_vectors(spark):
    p = points(150, 40, 5)
    assert same(lists(neighbors.knn_self(frame(spark, p), 5)), brute(p, p, 5))


def test_a_vector_that_a_third_of_the_rows_hold(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "HOT_ROWS", 10)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 32)
    monkeypatch.setattr(neighbors, "QUERY_ROWS", 16)
    p = points(200, 2, 6)
    p |= {100_000 + i: [0.5, 0.5] for i in range(100)}
    got = lists(neighbors.knn_self(frame(spark, p), 5, blocks=4))
    assert same(got, brute(p, p, 5))
    sent = neighbors._distinct_points(frame(spark, p).withColumnRenamed("features", "vec"), 5, "t")[0]
    assert sent.where(F.col("vec")[0] == 0.5).count() == 5


@pytest.mark.parametrize("hot_rows", [0, 100])
def test_negative_zero_is_zero(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(neighbors, "HOT_ROWS", hot_rows)
    p = {1: [0.0, 1.0], 2: [-0.0, 1.0], 3: [-0.0, 1.0], 4: [0.0, 2.0], 5: [3.0, -0.0], 6: [0.0, 1.0]}
    assert lists(neighbors.knn_self(frame(spark, p), 3)) == brute(p, p, 3)


def test_fewer_rows_than_k(spark):
    p = {1: [0.0], 2: [1.0], 3: [1.0]}
    assert lists(neighbors.knn_self(frame(spark, p), 5)) == brute(p, p, 5)
    alike = {1: [0.0], 2: [0.0]}
    assert lists(neighbors.knn_self(frame(spark, alike), 5)) == {}


def test_result_does_not_depend_on_partitions(spark):
    p = points(120, 2, 7)
    one, many = frame(spark, p).coalesce(1), frame(spark, p).repartition(11)
    assert lists(neighbors.knn_self(one, 3)) == lists(neighbors.knn_self(many, 3, blocks=3))


def test_neighbour_vectors(spark):
    p = points(60, 2, 8)
    for r in neighbors.knn_self(frame(spark, p), 2, with_vectors=True).collect():
        assert r.nbr_vec == p[r.nbr_id]


def test_merge_of_partial_lists(spark):
    rows = [(1, i, float(d)) for i, d in enumerate([1, 4, 5])]
    more = [(1, 10 + i, float(d)) for i, d in enumerate([2, 3, 6])]
    kind = "id bigint, nbr_id bigint, dist double"
    got = neighbors.merge_topk(spark.createDataFrame(rows, kind), spark.createDataFrame(more, kind), k=3)
    assert [r.dist for r in sorted(got.collect(), key=lambda r: r["rank"])] == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("bad", [[float("nan")], [float("inf")], [None], None])
def test_unusable_vectors_are_refused(spark, bad):
    df = spark.createDataFrame([(1, [1.0]), (2, bad)], "id bigint, features array<double>")
    with pytest.raises(ValueError):
        neighbors.knn_self(df, 1)


def test_arguments(spark):
    df = frame(spark, {1: [0.0], 2: [1.0]})
    for wrong in ({"k": 0}, {"blocks": 0}, {"blocks": -1}, {"metric": "cosine"}):
        with pytest.raises(ValueError):
            neighbors.knn_self(df, **wrong)
    with pytest.raises(TypeError):
        neighbors.knn_self(df.withColumn("id", F.lit("x")))
    with pytest.raises(ValueError):
        neighbors.knn_join(df, frame(spark, {1: [0.0, 1.0]}))


@pytest.mark.parametrize("dims", [1, 3, 20])
@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("grid", [None, 4])
@pytest.mark.parametrize("bounded", [False, True])
def test_one_block(dims, metric, grid, bounded):
    """A block large enough to be cut into leaves."""
    p = points(1200, dims, dims, grid)
    q = dict(itertools.islice(p.items(), 60)) | points(10, dims, 9)
    ids, c = np.array(list(p), dtype=np.int64), np.array(list(p.values()))
    bound = np.random.default_rng(0).random(len(q)) if bounded else None
    rows, cols, dist = blocks.nearest(np.array(list(q.values())), c, ids, 5, metric, True, bound)
    got = {k: [] for k in q}
    for r, i, d in zip(rows, cols, dist, strict=True):
        got[list(q)[r]].append((int(ids[i]), float(d)))
    want = brute(q, p, 5, metric)
    if bounded:
        want = {k: [f for f in found if f[1] <= b] for (k, found), b in zip(want.items(), bound, strict=True)}
    assert got == want


@pytest.mark.parametrize("offset, spread", [(1e9, 1.0), (-1e15, 64.0), (0.0, 1e-160), (0.0, 1e120)])
def test_screening_is_exact_far_from_zero(offset, spread):
    c = np.random.default_rng(5).integers(0, 4, (900, 6)) * spread + offset
    ids = np.arange(900, dtype=np.int64)
    want = brute(dict(enumerate(c[:50].tolist())), dict(enumerate(c.tolist())), 5)
    rows, cols, dist = blocks.nearest(c[:50], c, ids, 5, "euclidean", True)
    got = {i: [] for i in want}
    for r, i, d in zip(rows, cols, dist, strict=True):
        got[r].append((int(i), float(d)))
    assert got == want


def test_box_bound_never_exceeds_a_distance():
    rng = np.random.default_rng(3)
    c, q = rng.random((500, 5)), rng.random((40, 5)) * 2 - 0.5
    for metric in ("euclidean", "manhattan"):
        low = blocks.box_gap(q, q, c.min(axis=0)[None], c.max(axis=0)[None], metric)[:, 0]
        rows, _, dist = blocks.nearest(q, c, np.arange(500), 1, metric, False)
        assert (low[rows] <= dist).all()


def test_split_tree_keeps_equal_rows_together():
    x = np.zeros((100, 2))
    x[70:, 0] = np.arange(30)
    tree = blocks.split_tree(x, 8)
    leaf = blocks.leaf_of(tree, x)
    assert len(set(leaf[:70].tolist())) == 1
    assert leaf.max() < 8


@pytest.mark.parametrize("exclude_zero", [True, False])
@pytest.mark.parametrize("dims", [5, 64, 3000])
def test_manhattan_of_wide_vectors(dims, exclude_zero):
    """Coarse steps screen the pairs; copies, close ties and one far value."""
    rng = np.random.default_rng(dims)
    c = rng.normal(size=(1500 if dims < 100 else 60, dims))
    c[10:30] = np.round(c[10:30], 1)
    c[30:40] = c[10]
    c[40:50] = c[10]
    c[40:50, 0] += np.arange(10) * 1e-12
    c[55] *= 1e4
    q = np.concatenate([c[:60], rng.normal(size=(40, dims))])
    ids = rng.permutation(len(c)).astype(np.int64)
    rows, cols, dist = blocks.nearest(q, c, ids, 4, "manhattan", exclude_zero)
    want = brute(dict(enumerate(q)), dict(zip(ids.tolist(), c)), 4, "manhattan", exclude_zero)
    got = {}
    for r, i, d in zip(rows.tolist(), ids[cols].tolist(), dist.tolist()):
        got.setdefault(r, []).append((i, d))
    assert got == want
    if dims == 64:
        assert blocks._coarse(q[:55], c[:50]) is not None


@pytest.mark.parametrize("copies", [1, 3])
def test_few_blocks_asked_of_many_rows(spark, monkeypatch, copies):
    """A corpus gets the cells that its size asks for, whatever the number of blocks."""
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 32)
    asked = []
    cut = neighbors._cut_into_cells
    monkeypatch.setattr(neighbors, "_cut_into_cells", lambda c, n, w, cells: asked.append(cells) or cut(c, n, w, cells))
    p = points(320 * copies, 2, 8)
    got = lists(neighbors.knn_self(frame(spark, p), 3, blocks=2))
    assert same(got, brute(p, p, 3))
    assert asked == [40 * copies]
