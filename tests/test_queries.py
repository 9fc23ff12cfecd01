"""Every registered query against its check SQL on the given tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# results that are empty at the smallest scale
EMPTY = {"q02_duplicate_report", "j04_unmatched"}


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, folder, name):
    problem = compare(spark, con, name, QUERIES[name], ORACLES.get(name), folder)
    assert problem is None or (problem in ("both empty", "no rows") and name in EMPTY), problem


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
