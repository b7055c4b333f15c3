import pytest
from pyspark.sql import functions as F

from rebalance.operators import profile


def labelled(spark, n_pos, n_neg):
    return spark.range(n_pos + n_neg).select("id", F.when(F.col("id") < n_pos, "p").otherwise("n").alias("c"))


@pytest.mark.parametrize(
    "n_neg, n_pos, pct, target, create",
    [
        (500, 50, 50, 250, 200),
        (500, 50, 100, 500, 450),
        (500, 50, 150, 750, 700),
        (500, 50, 200, 1000, 950),
        (150, 100, 100, 150, 50),
        (333, 10, 50, 166, 156),
        (100, 100, 100, 100, 0),
        (100, 300, 100, 100, 0),
    ],
)
def test_sampling_plan(spark, n_neg, n_pos, pct, target, create):
    row = profile.sampling_plan(labelled(spark, n_pos, n_neg), "c", "p", pct).first()
    assert (row.target, row.num_syn) == (target, create)
    assert row.base_copies * n_pos + row.extra_seeds == create
    assert row.sqrt_num_pos == n_pos**0.5


def test_guards(spark):
    df = labelled(spark, 5, 20)
    with pytest.raises(ValueError):
        profile.sampling_plan(df, "c", "p", 0)
    with pytest.raises(ValueError):
        profile.check_plan(profile.sampling_plan(df, "c", "p", 100, k=5).first())
    profile.check_plan(profile.sampling_plan(df, "c", "p", 100, k=4).first())


def test_distribution_counts_three_classes(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "c string")
    got = {r.label: (r["count"], r.pct, r.total, r.num_classes) for r in profile.class_distribution(df, "c").collect()}
    assert got == {"a": (2, 50, 4, 3), "b": (1, 25, 4, 3), "c": (1, 25, 4, 3)}


def test_report_without_majority_is_null(spark):
    row = profile.balance_report(labelled(spark, 4, 0), "c", "p").first()
    assert (row.num_pos, row.num_neg, row.pos_pct, row.neg_pct) == (4, 0, None, None)


def test_partition_profile_sees_empty_partitions(spark):
    df = spark.range(0, 10, 1, 2).where("id < 5")
    row = profile.partition_profile(df).first()
    assert (row.min_rows, row.max_rows, row.avg_rows, row.num_partitions) == (0, 5, 2, 2)
