"""Every registered query against its SQL twin on the smallest tables.

The same run also looks at the plan: no cross join, and no Python between operators.
"""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracles.sql import oracle_statements
from tidemark.plans.catalog import QUERIES
from tools.check import compare, connect

TWINS = oracle_statements()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, folder, name):
    results = []

    def query(session, tables):
        results.append(QUERIES[name](session, tables))
        return results[0]

    state, rows, _, note = compare(spark, con, name, query, TWINS.get(name), folder)
    assert state in ("ok", "rows"), note
    assert note == ""
    if name != "b16_golden_cohort":
        assert rows > 0
    plan = results[0]._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas", "FlatMapGroups", "ArrowEval"):
        assert node not in plan
    assert "PythonUDF" not in plan


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "segment" in df.columns
