"""Every registered query with a SQL counterpart gives the same rows in both engines."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_rows(spark, con, name):
    diff, _, _, _ = compare(spark, con, SMALL, name, QUERIES[name], ORACLES[name])
    assert diff is None, diff


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
