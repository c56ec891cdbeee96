"""The registered corpus queries: one of each number, and those with SQL against it."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from tidemark.llm import queries


def test_all_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and {*queries.QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, sf, name):
    problem, _ = compare(spark, duck(sf), sf, queries.QUERIES[name], queries.ORACLES[name])
    assert problem is None, problem
