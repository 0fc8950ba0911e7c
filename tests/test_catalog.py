"""Every query against its SQL on the smallest tables."""

import pytest
from oracle_check import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    assert differences(queries()[name](spark, sf).toPandas(), con.execute(SQL[name]).df()) == []


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())
