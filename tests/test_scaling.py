import pytest
from pyspark.sql import functions as F

from rebalance.operators import scaling


def test_constant_column_and_round_trip(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0), (2.0, None)], "a double, b double")
    ranges = scaling.collect_ranges(df, ["a", "b"])
    out = scaling.minmax_transform(df, ["a", "b"], ranges)
    assert [tuple(r) for r in out.collect()] == [(0.0, 0.5), (1.0, 0.5), (0.5, None)]
    back = scaling.minmax_inverse(out, ["a", "b"], ranges)
    assert [tuple(r) for r in back.collect()] == [(1.0, 7.0), (3.0, 7.0), (2.0, None)]


def test_vector_and_columns_agree(spark):
    df = spark.range(50).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.lit(3.0).alias("c"))
    cols = ["a", "b", "c"]
    vec = df.select(F.array(*cols).alias("v"))
    ranges = scaling.collect_ranges(df, cols)
    assert ranges == scaling.collect_ranges(vec, "v")
    by_column = scaling.minmax_transform(df, cols, ranges).select(F.array(*cols).alias("v"))
    by_vector = scaling.minmax_transform(vec, "v", ranges)
    assert by_column.collect() == by_vector.collect()
    assert (
        scaling.minmax_inverse(by_vector, "v", ranges).collect()
        == scaling.minmax_inverse(scaling.minmax_transform(df, cols, ranges), cols, ranges)
        .select(F.array(*cols).alias("v"))
        .collect()
    )


def test_no_spread_can_be_null(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    assert scaling.minmax_transform(df, ["a"], scaling.Ranges((1.0,), (1.0,)), constant=None).first().a is None


@pytest.mark.parametrize("bad", ["null", "'NaN'", "'Infinity'", "'-Infinity'"])
def test_summary_counts_unusable_values(spark, bad):
    df = spark.sql(f"select 1D as a, 'p' as c union all select cast({bad} as double), 'n'")
    positive = F.col("c") == "p"
    by_column = scaling.summarize(df, scaling.Features.of(df, ["a"]), positive)
    vec = df.select("c", F.array("a").alias("v"))
    by_vector = scaling.summarize(vec, scaling.Features.of(vec, "v"), positive)
    for s in (by_column, by_vector):
        assert (s.num_all, s.num_pos, s.num_bad) == (2, 1, 1)


def test_summary_refuses_missing_and_uneven_vectors(spark):
    df = spark.sql("select array(1D, 2D) as v union all select array(3D) union all select null")
    s = scaling.summarize(df, scaling.Features.of(df, "v"), F.lit(True))
    assert (s.num_all, s.num_bad) == (3, 2)
