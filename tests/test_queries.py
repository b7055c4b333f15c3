"""Every registered query against its SQL twin, on the whole small tables."""

import oracle
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ours = QUERIES[name](spark, SF).toArrow()
    assert ours.num_rows
    if name in SQL:
        assert oracle.differences(ours, con.sql(SQL[name]).to_arrow_table()) is None


def test_partition_profile_counts_every_row(spark):
    row = QUERIES["partition_profile"](spark, SF).first()
    assert row.min_rows <= row.avg_rows <= row.max_rows
    assert row.num_partitions >= 1


def test_entry(spark):
    out = contract.entry(spark)
    assert out.where("is_synthetic").count() == 65  # 76 others, 11 toxic
    assert out.where("not is_synthetic").count() == 87
