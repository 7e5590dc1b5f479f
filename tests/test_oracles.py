"""Every query with an SQL counterpart, compared on the smallest data; the rest run."""

from __future__ import annotations

import pytest
from check_oracles import compare, connect

from barloom.plans import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    problem, _ = compare(QUERIES[name](spark, FOLDER), con, SQL[name])
    assert not problem


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"h1_fit_direction", "h2_fit_gbt", "g1_walk_forward"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 868
    assert set(contract.oracle_sql()) <= set(contract.queries())
