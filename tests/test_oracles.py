"""Every registered query against its SQL on the smallest tables."""

import pytest

from sieveline.plans import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(ORACLE_SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
