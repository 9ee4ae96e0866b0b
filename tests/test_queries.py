"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        diff, _ = compare(df, con, SQL[name])
        assert diff == ""
    else:
        df.collect()


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
