"""Table functions over the given tables take rows where they are dealt, without sorting them into a fixed number of shares."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry


@pytest.mark.parametrize("key", ["sql_envelope_items", "sql_paragraphs"])
def test_rows_are_not_sorted(spark, key):
    plan = entry.queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "UDTF" in plan
