"""Every query with an oracle agrees with DuckDB on the driver tables."""

import pytest

import __spark_entry__ as entry_mod
from risklens.plans.verify import compare, duck

SF = "/root/testdata/sf0.01"
SQL = entry_mod.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, con, key):
    df = entry_mod.queries()[key](spark, SF)
    r = compare(df, SQL[key], SF, con)
    assert r["ok"], r


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0 and "z_score" in df.columns
