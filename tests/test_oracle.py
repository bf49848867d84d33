"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from checks import oracle, queries
from checks.compare import connect, difference

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_all_are_registered():
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"prompt_batches"}


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_equals_sql(spark, con, key):
    problem = difference(QUERIES[key](spark, SF).toPandas(), con.execute(SQL[key]).df())
    assert problem is None, problem


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows(spark, key):
    assert QUERIES[key](spark, SF).limit(1).count() == 1


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert "fingerprint" in frame.columns and frame.count() > 0
