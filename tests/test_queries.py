"""Every registered query of the core against its SQL; those without SQL must run and give rows."""

import importlib

import pytest
from comparing import DATA, assert_same, connect

import __spark_entry__ as entry

MODS = [importlib.import_module(m) for m in entry.MODULES]
QUERIES = {k: q for m in MODS for k, q in m.QUERIES.items()}
SQL = {k: q for m in MODS for k, q in m.SQL.items()}
SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert_same(spark, con, QUERIES[name], SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, f"{DATA}/{SF}").count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_names():
    assert not set(SQL) - set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
