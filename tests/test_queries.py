"""Every registered query with SQL against DuckDB on the same tables."""

import pytest

from corpusflow.plans import ORACLE, QUERIES
from tests.oracle import connect, difference


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf, con, name):
    assert difference(spark, con, sf, QUERIES[name], ORACLE[name]) is None


def test_entry_has_rows(spark):
    import __spark_entry__ as e
    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_unchecked_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
