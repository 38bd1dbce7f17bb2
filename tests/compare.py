"""Run registered queries next to their DuckDB SQL and compare values (order-insensitive)."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _sortable(row):
    return tuple((x is not None, type(x).__name__ if not isinstance(x, (int, float)) else "n", x if x is not None else 0) for x in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=_sortable)


def compare(spark_rows, spark_cols, duck_rows, duck_cols, tol: float = 0.0) -> str:
    """Empty text when equal, else the first difference."""
    ca, a = rows_of(spark_cols, spark_rows)
    cb, b = rows_of(duck_cols, duck_rows)
    if ca != cb:
        return f"columns {ca} vs {cb}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = 0
    first = ""
    for x, y in zip(a, b):
        for i, (p, q) in enumerate(zip(x, y)):
            same = p == q
            if not same and tol and isinstance(p, (int, float)) and isinstance(q, (int, float)):
                same = abs(p - q) <= tol * max(1.0, abs(p), abs(q))
            if not same:
                bad += 1
                first = first or f"{ca[i]}: {p!r} vs {q!r} in {x} / {y}"
                break
    return f"{bad} of {len(a)} rows differ; {first}"[:900] if bad else ""


def check(spark, con, key, fn, sql, sf_dir) -> tuple[str, int, float, float]:
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return ("" if got else "no rows"), len(got), t1 - t0, 0.0
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    problem = compare(got, df.columns, want, cols)
    if not problem:
        types = {c[0]: str(c[1]) for c in cur.description}
        kinds = dict(df.dtypes)
        pair = {"bigint": ("BIGINT", "NUMBER"), "int": ("INTEGER",), "double": ("DOUBLE",), "string": ("VARCHAR", "STRING"), "boolean": ("BOOLEAN", "bool")}
        odd = {c: (kinds[c], types[c]) for c in kinds if types[c].upper() not in tuple(p.upper() for p in pair.get(kinds[c], ()))}
        if odd and os.environ.get("TYPES"):
            print("   types", key, odd)
    return problem, len(got), t1 - t0, t2 - t1


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[8]")).config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidewater-compare-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = argv or list(queries)
    failed = 0
    for key in wanted:
        try:
            problem, n, ts, td = check(spark, con, key, queries[key], oracles.get(key), sf_dir)
        except Exception as error:  # report and go on with the next key
            problem, n, ts, td = f"{type(error).__name__}: {str(error)[:700]}", -1, 0, 0
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {key:24s} rows={n:<7d} spark={ts:5.2f}s duck={td:5.2f}s {'' if key in oracles else '(rows only)'} {problem}", flush=True)
    print(f"{len(wanted) - failed}/{len(wanted)} pass")


if __name__ == "__main__":
    main(sys.argv[1:])
