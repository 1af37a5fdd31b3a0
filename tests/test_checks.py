"""Every registered query with SQL agrees with it, bit for bit, on the small tables."""

import pytest
from compare import connection, difference, spark_result, sql_result, type_difference

import __spark_entry__ as entry

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, con, small, name):
    df = QUERIES[name](spark, small)
    assert type_difference(df, con, SQL[name]) == ""
    assert difference(spark_result(df), sql_result(con, SQL[name])) is None


def test_every_check_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() == 5
