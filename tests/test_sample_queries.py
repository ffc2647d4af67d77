"""Every registered query against its SQL definition on the smallest sample."""

from __future__ import annotations

import sys

import pytest

from __spark_entry__ import entry, oracle_sql
from factloom.plans.registry import QUERIES
from factloom.session import materialize
from tests.compare import connect, differences
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.fixture
def plans(monkeypatch):
    """Physical plans of everything a query stores on its way."""
    seen = []

    def recording(df, label):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, label)

    for module in list(sys.modules.values()):
        if module.__name__.startswith("factloom.") and hasattr(module, "materialize"):
            monkeypatch.setattr(module, "materialize", recording)
    return seen


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, plans, name):
    rows, wrong = differences(spark, con, SMALL, name, plans)
    assert not wrong
    assert rows > 0
    for plan in plans:
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0
