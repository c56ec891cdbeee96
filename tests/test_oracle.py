"""Every registered query against its SQL twin on the same files."""

import pytest

import __spark_entry__ as entry
from tidemark import plans
from compare import compare, duck

QUERIES, ORACLES = plans.all_queries(), plans.all_oracles()


@pytest.fixture(scope="session")
def con(sf):
    return duck(sf)


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    problem, _ = compare(spark, con, sf, QUERIES[name], ORACLES[name])
    assert problem is None, problem
