import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rebalance.operators import neighbors, ranking, scaling, synth
from rebalance import staging
from rebalance.plans.balance import balance

FEATURES = ["x", "y"]


def table(spark, n_pos=30, n_neg=100, seed=0):
    rng = np.random.default_rng(seed)
    values = rng.random((n_pos + n_neg, 2)) * [10, 500]
    rows = [(i, "p" if i < n_pos else "n", float(a), float(b), f"t{i}") for i, (a, b) in enumerate(values)]
    return spark.createDataFrame(rows, "id bigint, c string, x double, y double, note string")


@pytest.mark.parametrize("seed", [1, 2, 1286082570])
@pytest.mark.parametrize("over_pct", [50, 100, 230])
def test_synthetic_rows_lie_between_seed_and_neighbour(spark, seed, over_pct):
    df = table(spark, seed=seed)
    ranges = scaling.collect_ranges(df, FEATURES)
    made = synth.smote(df, "c", "p", FEATURES, "id", k=4, over_pct=over_pct, seed=seed).collect()
    assert len(made) == 100 * over_pct // 100 - 30
    scaled = scaling.minmax_transform(df, FEATURES, ranges).where("c = 'p'")
    nearest = {}
    for r in neighbors.knn_self(scaled.select("id", F.array(*FEATURES).alias("features")), 4).collect():
        nearest.setdefault(r.id, set()).add(r.nbr_id)
    original = {r.id: (r.x, r.y) for r in df.collect()}
    copies = {}
    for r in made:
        assert r.c == "p" and r.nbr_id in nearest[r.seed_id] and 0 <= r.gap < 1
        s, t = original[r.seed_id], original[r.nbr_id]
        assert [r.x, r.y] == pytest.approx([a + (b - a) * r.gap for a, b in zip(s, t, strict=True)])
        copies.setdefault(r.seed_id, []).append(r.copy)
    counts = [len(c) for c in copies.values()] + [0] * (30 - len(copies))
    assert max(counts) - min(counts) <= 1
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values())


def test_output_is_the_same_for_any_layout(spark):
    df = table(spark)
    want = sorted(synth.smote(df.coalesce(1), "c", "p", FEATURES, "id").collect())
    assert sorted(synth.smote(df.repartition(13), "c", "p", FEATURES, "id", blocks=3).collect()) == want
    assert sorted(synth.smote(df, "c", "p", FEATURES, "id", num_partitions=5).collect()) == want
    assert sorted(synth.smote(df, "c", "p", FEATURES, "id", seed=9).collect()) != want


def test_vector_feature_gives_the_same_rows(spark):
    df = table(spark)
    want = {(r.seed_id, r.copy): [r.x, r.y] for r in synth.smote(df, "c", "p", FEATURES, "id").collect()}
    vec = df.select("id", "c", F.array(*FEATURES).alias("v"))
    assert {(r.seed_id, r.copy): r.v for r in synth.smote(vec, "c", "p", "v", "id").collect()} == want


def test_without_id_column(spark):
    made = synth.smote(table(spark), "c", "p", FEATURES)
    assert made.count() == 70
    assert made.collect() == made.collect()


def test_balance_keeps_the_original_rows(spark):
    df = table(spark)
    out = balance(df, "c", "p", FEATURES, "id")
    assert sorted(out.where("not is_synthetic").drop("is_synthetic").collect()) == sorted(df.collect())
    made = out.where("is_synthetic")
    assert made.count() == 70
    assert made.where("id is not null or note is not null or c <> 'p'").count() == 0
    assert {"seed_id", "copy", "nbr_id", "gap"} <= set(balance(df, "c", "p", FEATURES, "id", lineage=True).columns)


def test_three_classes_keep_their_labels(spark):
    df = table(spark).withColumn("c", F.when(F.col("id") >= 100, "o").otherwise(F.col("c")))
    counts = {r.c: r["count"] for r in balance(df, "c", "p", FEATURES, "id").groupBy("c").count().collect()}
    assert counts == {"p": 100, "n": 70, "o": 30}


def test_nothing_to_create(spark):
    for n_pos in (100, 150):
        df = table(spark, n_pos, 100)
        assert synth.smote(df, "c", "p", FEATURES, "id").count() == 0
        assert balance(df, "c", "p", FEATURES).count() == n_pos + 100


def test_rows_all_alike_are_copied(spark):
    is_p = F.col("c") == "p"
    df = table(spark, 8, 40).withColumn("x", F.lit(4.0)).withColumn("y", F.when(is_p, 7.0).otherwise(F.col("y")))
    made = synth.smote(df, "c", "p", FEATURES, "id", k=3).collect()
    assert len(made) == 32
    assert all(r.nbr_id is None and r.x == 4.0 and r.y == pytest.approx(7.0) for r in made)


def test_fewer_neighbours_than_k(spark):
    """Two distinct vectors: every seed has just the copies of the other one."""
    is_p = F.col("c") == "p"
    df = table(spark, 8, 40).withColumns(
        {
            "x": F.when(is_p, (F.col("id") % 2).cast("double")).otherwise(F.col("x")),
            "y": F.when(is_p, 7.0).otherwise(F.col("y")),
        }
    )
    made = synth.smote(df, "c", "p", FEATURES, "id", k=7).collect()
    assert len(made) == 32
    assert all(r.nbr_id % 2 != r.seed_id % 2 for r in made)


def test_guards(spark):
    df = table(spark, 5, 40)
    for wrong in ({"k": 5}, {"over_pct": 0}, {"over_pct": -1}, {"blocks": 0}, {"metric": "cosine"}, {"k": 0}):
        with pytest.raises(ValueError):
            synth.smote(df, "c", "p", FEATURES, "id", **({"k": 4} | wrong))
    assert synth.smote(df, "c", "p", FEATURES, "id", k=4).count() == 35
    with pytest.raises(ValueError):
        synth.smote(df.withColumn("x", F.lit(None).cast("double")), "c", "p", FEATURES, "id", k=4)


@pytest.mark.parametrize("twice", ["id div 2", "nullif(id, 3)"])
def test_ids_must_be_unique(spark, twice):
    df = table(spark).withColumn("id", F.expr(twice))
    with pytest.raises(ValueError, match="unique"):
        synth.smote(df, "c", "p", FEATURES, "id")
    assert synth.smote(df, "c", "p", FEATURES).count() == 70


def test_global_rank(spark):
    df = spark.range(5000).select(F.col("id"), (F.rand(3) * 50).cast("int").alias("g")).repartition(9)
    got = ranking.global_rank(df, "g", "id").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert [(r.g, r.id) for r in got] == sorted((r.g, r.id) for r in got)


@pytest.mark.parametrize("num_syn", [0, 1, 99, 100, 101, 777])
def test_copies_add_up(spark, num_syn):
    seeds = spark.range(100)
    got = {r.id: r.copies for r in synth.allocate_copies(seeds, num_syn, 100).collect()}
    assert sum(got.values()) == num_syn
    drawn = seeds.select("id", synth.quota_draw(synth.SEED, "id").alias("d")).orderBy("d", "id").collect()
    more = {r.id for r in drawn[: num_syn % 100]}
    assert got == {i: num_syn // 100 + (i in more) for i in range(100)}


def test_many_copies_are_dealt_out(spark, monkeypatch):
    df = table(spark, 6, 400)
    want = sorted(synth.smote(df, "c", "p", FEATURES, "id").collect())
    monkeypatch.setattr(synth, "RUN", 7)
    monkeypatch.setattr(synth, "ROWS_PER_TASK", 100)
    dealt = synth.smote(df, "c", "p", FEATURES, "id")
    assert sorted(dealt.collect()) == want
    assert dealt.rdd.getNumPartitions() == 4


def test_staged_tables_can_be_dropped(spark):
    df = staging.stage(spark.range(5), "t")
    assert df.count() == 5
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    staging.drop_staged(spark)
    assert not os.path.exists(folder)


@pytest.mark.parametrize("over_pct", [60, 200])
def test_rows_that_share_an_id_are_seeds_of_their_own(spark, over_pct):
    df = table(spark).withColumn("id", F.expr("case when id between 10 and 19 then 10 else id end"))
    made = synth.smote(df, "c", "p", FEATURES, "id", k=4, over_pct=over_pct, repeated_ids=True).collect()
    assert len(made) == over_pct - 30
    ranges = scaling.collect_ranges(df, FEATURES)
    scaled = scaling.minmax_transform(df, FEATURES, ranges).where("c = 'p'").collect()
    pairs = set()
    for r in scaled:
        others = sorted((abs(r.x - t.x) ** 2 + abs(r.y - t.y) ** 2, i) for i, t in enumerate(scaled) if t is not r)
        pairs |= {(r.id, scaled[i].id) for _, i in others[:4]}
    assert {(r.seed_id, r.nbr_id) for r in made} <= pairs
    copies = {}
    for r in made:
        copies.setdefault((r.seed_id, r.copy), []).append((r.x, r.y))
    full = (over_pct - 30) // 30
    for copy in range(1, full + 1):
        assert len(set(copies[10, copy])) == 10 and len(copies[9, copy]) == 1
    again = synth.smote(df.repartition(7), "c", "p", FEATURES, "id", k=4, over_pct=over_pct, repeated_ids=True)
    assert sorted(again.collect()) == sorted(made)
    with pytest.raises(ValueError, match="null"):
        synth.smote(df.withColumn("id", F.expr("nullif(id, 3)")), "c", "p", FEATURES, "id", repeated_ids=True)


def test_unique_ids_give_the_same_rows_where_they_might_repeat(spark):
    df = table(spark)
    want = sorted(synth.smote(df, "c", "p", FEATURES, "id").collect())
    assert sorted(synth.smote(df, "c", "p", FEATURES, "id", repeated_ids=True).collect()) == want


@pytest.mark.parametrize("num_syn", [3, 13, 20, 27])
def test_copies_of_seeds_that_share_an_id_add_up(spark, num_syn):
    seeds = spark.range(20).select((F.col("id") % 2).alias("id"))
    made = synth.allocate_copies(seeds, num_syn)
    assert made.columns == ["id", "copies"]
    assert made.count() == 20 and made.agg(F.sum("copies")).first()[0] == num_syn
