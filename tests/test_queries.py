"""Every registered query against its SQL on DuckDB."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf_dir, name):
    ok, note = compare(spark, con, QUERIES[name], ORACLES[name], sf_dir)
    assert ok, note


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_all_oracles_are_queries():
    assert set(ORACLES) <= set(QUERIES)
