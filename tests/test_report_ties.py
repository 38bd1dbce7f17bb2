"""Scores on a rounding tie: the order in which a mean is summed must not decide."""

import os
import random
import sys
import tempfile

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry
from compare import compare


@pytest.fixture(scope="module")
def ties():
    """Stations whose mean discount is an odd number of fifteenths of a percent, so that their score ends in half a thousandth."""
    rng, rows = random.Random(5), []
    for station in range(200):
        n = 15 * rng.randrange(1, 6)
        wanted = n // 15 * rng.randrange(61, 91, 2)
        cents = [rng.randrange(0, 11) for _ in range(n)]
        while sum(cents) != wanted:
            i = rng.randrange(n)
            cents[i] = min(10, cents[i] + 1) if sum(cents) < wanted else max(0, cents[i] - 1)
        rows += [(station * 100 + i, c / 100) for i, c in enumerate(cents)]
    path = tempfile.mkdtemp(prefix="ties-")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k BIGINT, d DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    con.execute(
        "COPY (SELECT k AS l_orderkey, k AS l_partkey, k // 100 AS l_suppkey, CAST(1 AS INT) AS l_linenumber, CAST(30 AS DOUBLE) AS l_quantity, "
        "CAST(90000 AS DOUBLE) AS l_extendedprice, d AS l_discount, CAST(0.02 AS DOUBLE) AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, "
        f"TIMESTAMP '1996-01-01' AS l_shipdate FROM t) TO '{path}/lineitem.parquet' (FORMAT parquet)"
    )
    return path


def test_report_templates_on_ties(spark, ties):
    got = entry.queries()["report_templates"](spark, ties)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{ties}/lineitem.parquet')")
    want = con.execute(entry.oracle_sql()["report_templates"])
    columns = [c[0] for c in want.description]
    assert compare([tuple(r) for r in got.collect()], got.columns, want.fetchall(), columns) == ""
