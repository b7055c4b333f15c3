"""What plans and staged tables look like, and the job from file to file."""

import glob
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rebalance import (
    allocate_copies,
    balance,
    global_rank,
    knn_join,
    knn_self,
    merge_topk,
    minmax_fit,
    partition_profile,
    sampling_plan,
    smote,
)
from rebalance.operators import neighbors
from rebalance.plans.job import run
from rebalance.staging import checkpoint_dir, drop_staged, new_path, staging_run

HEADER = """@relation t
@attribute x real [0, 1]
@attribute colour {red, blue}
@attribute class {positive, negative}
@inputs x, colour
@outputs class
@data
"""


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def vectors(spark, n, dims, seed, ids=None):
    rng = np.random.default_rng(seed)
    rows = [(int(ids[i]) if ids is not None else i, x) for i, x in enumerate(rng.random((n, dims)).tolist())]
    return spark.createDataFrame(rows, "id bigint, features array<double>")


def test_queries_stay_where_they_are(spark):
    queries = vectors(spark, 400, 3, 1).repartition(16)
    found = knn_join(queries, vectors(spark, 50, 3, 2), 4)
    assert "Exchange" not in plan(found)
    assert found.count() == 1600


@pytest.mark.parametrize("blocks", [1, 4])
def test_repeated_ids_each_have_their_own_list(spark, blocks):
    ids = np.arange(120) % 7
    df = vectors(spark, 120, 2, 3, ids)
    got = sorted((r.id, r["rank"], r.nbr_id, r.dist) for r in knn_self(df, 3, blocks=blocks).collect())
    x = np.random.default_rng(3).random((120, 2))
    want = []
    for i in range(120):
        gap = x[i] - x
        d = np.sqrt(gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1])
        near = sorted((d[j], int(ids[j])) for j in range(120) if d[j] > 0)[:3]
        want += [(int(ids[i]), r, nbr, dist) for r, (dist, nbr) in enumerate(near, 1)]
    assert got == sorted(want)


def test_routes_hold_no_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbors, "QUERY_ROWS", 64)
    with staging_run(spark) as folder:
        df = vectors(spark, 300, 20, 4)
        many = sorted(map(tuple, knn_self(df, 5, blocks=9).collect()))
        routes = glob.glob(folder.removeprefix("file:") + "/routes-*")
        assert len(routes) == 1
        table = spark.read.parquet(routes[0])
        assert table.columns == ["to", "visited", "meeting"]
        assert table.count() == table.select("to", "visited").distinct().count() > 0
    monkeypatch.undo()
    assert many == sorted(map(tuple, knn_self(df, 5).collect()))


def test_pivots_rule_out_cells_that_boxes_do_not():
    from rebalance.operators import blocks as B

    # a ring around the origin: its box holds the query, its pivot and radius do not rule it out, a far one's do
    x = np.array([[0.0, 0.0]])
    lo, hi = np.array([[-5.0, -5.0], [-1.0, 3.0]]), np.array([[5.0, 5.0], [1.0, 9.0]])
    pivots, radii = np.array([[4.0, 4.0], [0.0, 8.0]]), np.array([1.0, 1.0])
    near = [c.tolist() for _, c in B.cells_in_reach(x, np.array([3.0]), np.array([0]), lo, hi, pivots, radii, "euclidean")]
    assert near == [[]]
    near = [c.tolist() for _, c in B.cells_in_reach(x, np.array([7.5]), np.array([0]), lo, hi, pivots, radii, "euclidean")]
    assert near == [[0, 1]]


def test_overlapping_lists_give_distinct_neighbours(spark):
    rows = [(1, 1, 10, 0.5), (1, 2, 11, 0.7), (1, 3, 12, 0.7)]
    a = spark.createDataFrame(rows, "id bigint, rank int, nbr_id bigint, dist double")
    b = spark.createDataFrame([(1, 1, 10, 0.5), (1, 2, 13, 0.9), (2, 1, 1, 0.1)], a.schema)
    got = sorted(map(tuple, merge_topk(a, b, k=3).collect()))
    assert got == [(1, 1, 10, 0.5), (1, 2, 11, 0.7), (1, 3, 12, 0.7), (2, 1, 1, 0.1)]


def test_smote_looks_vectors_up_after_the_draw(spark):
    with staging_run(spark) as folder:
        df = vectors(spark, 200, 3, 5).withColumn("c", F.when(F.col("id") % 5 == 0, "rare").otherwise("other"))
        made = smote(df, "c", "rare", "features", "id")
        assert made.count() == 120
        for path in glob.glob(folder.removeprefix("file:") + "/*"):
            assert "nbr_vec" not in spark.read.parquet(path).schema.simpleString()


def test_seeds_are_counted(spark):
    seeds = spark.range(10)
    assert allocate_copies(seeds, 23).agg(F.sum("copies")).first()[0] == 23
    with pytest.raises(ValueError, match="10 seeds, not 9"):
        allocate_copies(seeds, 23, 9)
    with pytest.raises(ValueError, match="no seeds"):
        allocate_copies(seeds.limit(0), 1)
    assert allocate_copies(seeds.limit(0), 0).collect() == []


def test_ids_are_checked_even_if_nothing_is_made(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (3, "b", 3.0)], "id bigint, c string, x double")
    with pytest.raises(ValueError, match="unique"):
        smote(df, "c", "a", ["x"], "id", k=1, over_pct=10)
    with pytest.raises(TypeError):
        smote(df, "c", "a", ["x"], "x", k=1)


def test_vector_ranges_without_a_row_per_item(spark):
    df = spark.createDataFrame(
        [([1.0, float("nan"), None],), ([-2.0, 3.0],), (None,), ([5.0, 4.0, None, 7.0],)], "v array<double>"
    )
    fitted = minmax_fit(df.repartition(3), "v")
    assert "Generate" not in plan(fitted)
    got = {r.col_idx: (r.col_name, r["min"], r["max"]) for r in fitted.collect()}
    assert got[0] == ("v_0", -2.0, 5.0) and got[2] == ("v_2", None, None) and got[3] == ("v_3", 7.0, 7.0)
    assert got[1][1] == 3.0 and np.isnan(got[1][2])


def test_one_value_in_most_rows_is_ranked_by_many_tasks(spark):
    df = spark.range(0, 40_000, 1, 5).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("x"))
    with staging_run(spark) as folder:
        ranked = global_rank(df, "x")
        ends = ranked.groupBy(F.col("x") == -1).agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).collect()
        assert sorted(tuple(r)[1:] for r in ends) == [(1, 36_000, 36_000), (36_001, 40_000, 4_000)]
        (path,) = glob.glob(folder.removeprefix("file:") + "/ranges-*")
        sizes = [spark.read.parquet(f).count() for f in glob.glob(path + "/*.parquet")]
        assert max(sizes) <= 2 * np.median(sizes)


def test_several_percentages_read_the_table_once(spark, tmp_path):
    spark.range(100).select(F.when(F.col("id") < 10, 1).otherwise(0).alias("c")).write.parquet(str(tmp_path / "t"))
    plans = sampling_plan(spark.read.parquet(str(tmp_path / "t")), "c", 1, [50, 100, 300])
    assert plan(plans).count("Scan parquet") == 2  # one node: in the tree and in the details
    assert [(r.over_pct, r.num_syn) for r in plans.orderBy("over_pct").collect()] == [(50, 35), (100, 80), (300, 260)]
    with pytest.raises(ValueError):
        sampling_plan(spark.range(3), "id", 1, [100, 0])


def test_partitions_without_rows_count(spark):
    df = spark.range(0, 10, 1, 5).where("id < 4")
    assert tuple(partition_profile(df).first()) == (0, 2, 0, 5)
    assert tuple(partition_profile(df.coalesce(1)).first()) == (4, 4, 4, 1)
    assert tuple(partition_profile(df.limit(0)).first())[:3] == (0, 0, 0)
    assert "Python" not in plan(partition_profile(df)) and "MapInArrow" not in plan(partition_profile(df))


def test_balance_keeps_types_and_values(spark):
    big = 2**53 + 1
    rows = [(i, "p" if i < 4 else "n", big + i, float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "id bigint, c string, b bigint, x double").withColumn("d", F.col("x").cast("decimal(9,2)"))
    out = balance(df, "c", "p", ["b", "x", "d"], "id", k=2)
    assert dict(out.dtypes)["b"] == "bigint" and dict(out.dtypes)["d"] == "decimal(9,2)"
    assert {r.id: r.b for r in out.where("not is_synthetic").collect()} == {i: big + i for i in range(12)}
    assert out.where("is_synthetic").count() == 4
    ints = df.select("id", "c", F.array("b").alias("v"))
    assert dict(balance(ints, "c", "p", "v", "id", k=2).dtypes)["v"] == "array<bigint>"


@pytest.fixture
def files(spark, tmp_path):
    (tmp_path / "h.txt").write_text(HEADER)

    def write(*more):
        rng = random.Random(1)
        lines = [f"{rng.random()},{rng.choice(['red', 'blue'])},{'positive' if i < 8 else 'negative'}" for i in range(40)]
        (tmp_path / "d.csv").write_text("\n".join([*lines, *more]) + "\n")
        return str(tmp_path / "h.txt"), str(tmp_path / "d.csv"), str(tmp_path / "out")

    return write


def test_job_counts_what_it_read(spark, files):
    row = run(spark, *files("", "@comment"), k=3).first()
    assert (row.num_pos, row.num_neg, row.num_lines, row.num_rejected) == (32, 32, 41, 1)


@pytest.mark.parametrize("line", ["0.5,red,positiv", "0.5,green,positive", "x,red,positive", "0.5,red,7"])
def test_job_stops_at_an_undeclared_label_or_lists_it(spark, files, line):
    header, data, out = files(line)
    with pytest.raises(Exception, match="undeclared label|CAST_INVALID_INPUT"):
        run(spark, header, data, out, k=3)
    row = run(spark, header, data, out, k=3, on_error="reject").first()
    assert (row.num_pos, row.num_neg, row.num_lines, row.num_rejected) == (32, 32, 41, 1)


def test_a_class_may_be_given_by_its_code(spark, files):
    header, data, out = files("0.5,red,1")
    assert run(spark, header, data, out, k=3).first().num_neg == 33
    assert spark.read.text(out).where(F.endswith(F.col("value"), F.lit(", negative"))).count() == 33


def test_results_outlive_a_job(spark, files):
    df = vectors(spark, 60, 2, 6).withColumn("c", F.when(F.col("id") < 12, "p").otherwise("n"))
    held = balance(df, "c", "p", "features", "id")
    run(spark, *files(), k=3)
    assert held.count() == 96


def test_runs_have_folders_of_their_own(spark):
    outside = new_path(spark, "kept")
    spark.range(3).write.parquet(outside)
    with pytest.raises(RuntimeError), staging_run(spark) as folder:
        spark.range(5).write.parquet(new_path(spark, "gone"))
        assert len(os.listdir(folder.removeprefix("file:"))) == 1
        raise RuntimeError
    assert not os.path.exists(folder.removeprefix("file:"))
    assert spark.read.parquet(outside).count() == 3
    assert outside.startswith(checkpoint_dir(spark))
    drop_staged(spark)
    assert not os.path.exists(outside.removeprefix("file:"))
