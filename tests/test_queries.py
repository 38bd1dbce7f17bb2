"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest
from compare import check, connect

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    problem, _, _, _ = check(spark, duck, key, QUERIES[key], ORACLES.get(key), SF_DIR)
    assert not problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0
