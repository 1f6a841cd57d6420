"""Every registered query with oracle SQL equals DuckDB on the smallest data."""

import pytest

import __spark_entry__ as entry
from almanac.plans import QUERIES
from tools.check_oracle import compare, duckdb_views

from .conftest import SF_SMALL

SQL = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duckdb_views(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    ok, detail = compare(spark, con, entry.queries()[name], SQL[name], SF_SMALL)
    assert ok, detail

