"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import compare, connect
from leafmill.fixtures.registry import QUERIES

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_of_the_library_has_sql():
    assert set(QUERIES) <= set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, sf, con, name):
    ok, note, _ = compare(spark, con, name, entry.queries()[name], SQL[name], sf)
    assert ok, note


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
