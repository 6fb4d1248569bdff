"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from workload.check import compare, connect

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, sf, duck):
    ok, note = compare(duck, spark, sf, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark, sf):
    assert contract.entry(spark).count() == 3
