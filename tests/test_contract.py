"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, rows_of


@pytest.fixture(scope="module")
def connection(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_matches_sql(spark, small, connection, name):
    df = contract.queries()[name](spark, small)
    expected = connection.sql(contract.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(expected.columns, expected.fetchall())


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
