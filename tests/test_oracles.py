"""Every query that SQL can express, against DuckDB on the same files."""

import pytest

import __spark_entry__ as entry_module
from compare import differences, duck

ORACLES = entry_module.oracle_sql()
QUERIES = entry_module.queries()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows(name, spark, sf, con):
    assert differences(QUERIES[name](spark, sf), con, ORACLES[name]) == []


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() == 1
