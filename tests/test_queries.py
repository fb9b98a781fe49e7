"""Every core query with SQL gives the rows of that SQL."""

import pytest

from tests.compare import same
from tradeloom import queries_core
from tradeloom.plans import market_queries, quality_queries, reconcile_queries, scalar_queries, selection_queries, source_queries, temporal_queries

MODULES = (queries_core, scalar_queries, quality_queries, reconcile_queries, temporal_queries, market_queries, selection_queries, source_queries)
Q = {k: f for m in MODULES for k, f in m.queries().items()}
SQL = {k: s for m in MODULES for k, s in m.oracle_sql().items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, name):
    same(Q[name](spark, data).toPandas(), SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_runs_without_sql(spark, data, name):
    df = Q[name](spark, data)
    assert df.columns and df.count() >= 0
