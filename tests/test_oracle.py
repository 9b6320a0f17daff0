"""Every query with reference SQL gives the same values as DuckDB on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, SMALL)
    assert ok, note


def test_sql_names_are_queries():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
