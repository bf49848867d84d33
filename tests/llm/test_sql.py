"""Queries of this folder against their SQL on the smallest tables."""

import pytest

from checks.compare import connect, difference
from siftspark.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_statement_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("key", sorted(oracle_sql()))
def test_query_equals_sql(llm_spark, con, key):
    problem = difference(queries()[key](llm_spark, SF).toPandas(), con.execute(oracle_sql()[key]).df())
    assert problem is None, problem
