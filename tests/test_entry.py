"""Driver contract: entry(), queries() and oracle_sql() on the sf0.001 tables."""

import pytest

import __spark_entry__ as E
from ledgerlens.plans.catalog import QUERIES


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert set(df.columns) == {"region", "total_revenue", "total_cogs", "total_sga", "row_count", "factor_rows"}


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_returns_rows(spark, name):
    held = lambda: set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    before = held()
    df = E.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.limit(1).count() == 1 and len(set(df.columns)) == len(df.columns)
    assert held() <= before, "a query left a persisted frame"
