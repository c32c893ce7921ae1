"""Every registered query against its SQL in DuckDB on the smallest tables."""

import pytest

from oracle import compare, connect
from sigspark.plans import catalog


@pytest.fixture(scope="module")
def duck(sf001):
    return connect(sf001)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, sf001, name):
    diff = compare(spark, duck, sf001, name, catalog.QUERIES[name], catalog.ORACLES[name])
    assert diff is None, diff


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_returns_rows(spark, sf001, name):
    assert catalog.QUERIES[name](spark, sf001).count() > 0
