"""Each query with SQL of its own, run by Spark and by DuckDB over the same tables."""

from __future__ import annotations

import pytest

from patraka.plans import oracles
from patraka.plans.queries import QUERIES
from tests.compare import duck, same


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_same_as_sql(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, oracles.SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracles.SQL)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
