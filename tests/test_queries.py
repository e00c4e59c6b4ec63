"""Every named query against its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    ok, message = compare(spark, db, FOLDER, name, QUERIES[name], ORACLE.get(name))
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
