"""Registration and the table bindings shared by queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def stable_rounding(sql: str) -> str:
    """``round(x, n)`` of doubles as decimal half-up rounding, free of binary noise at the tie."""
    out, i = "", 0
    while True:
        at = sql.find("round(", i)
        if at < 0:
            return out + sql[i:]
        out += sql[i:at]
        depth, j, commas = 0, at + 5, []
        while True:
            ch = sql[j]
            depth += (ch in "([") - (ch in ")]")
            if ch == "," and depth == 1:
                commas.append(j)
            if depth == 0:
                break
            j += 1
        inner = stable_rounding(sql[at + 6 : commas[-1]])
        digits = sql[commas[-1] + 1 : j].strip()
        out += f"CAST(round(CAST({inner} AS DECIMAL(32, 10)), {digits}) AS DOUBLE)"
        i = j + 1


def query(key: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``key`` with its optional DuckDB SQL."""

    def register(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = stable_rounding(oracle)
        return fn

    return register


# Columns of the given tables; an explicit schema spares a footer read per scan
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
    "l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{d}/{name}.parquet")


# Binding views, identical in meaning in both engines: name -> (views it uses, SQL)
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_readings": ((), "SELECT event_id, user_id AS sensor_id, ts AS observed_at, event_type AS field, value FROM events"),
    "v_farms": (
        (),
        "SELECT c_custkey AS farm_id, c_name AS farm_name, c_nationkey AS region_id, "
        "CAST(34 AS DOUBLE) + CAST(c_custkey * 37 % 281 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat, "
        "CAST(125.3 AS DOUBLE) + CAST(c_custkey * 53 % 271 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon FROM customer",
    ),
    "v_stations": (
        (),
        "SELECT s_suppkey AS station_id, s_name AS station_name, s_nationkey AS region_id, "
        "CAST(34 AS DOUBLE) + CAST(s_suppkey * 41 % 281 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat, "
        "CAST(125.3 AS DOUBLE) + CAST(s_suppkey * 59 % 271 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon FROM supplier",
    ),
    "v_station_obs": (
        (),
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS obs_date, "
        "CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity * CAST(0.6 AS DOUBLE) END AS water_temp, "
        "CAST(28 AS DOUBLE) + l_discount * CAST(50 AS DOUBLE) AS salinity, "
        "CAST(2 AS DOUBLE) + l_quantity * CAST(0.15 AS DOUBLE) AS dissolved_oxygen, "
        "l_extendedprice / CAST(500 AS DOUBLE) AS din_ugl, CAST(1 AS DOUBLE) + l_tax * CAST(400 AS DOUBLE) AS dip_ugl "
        "FROM lineitem",
    ),
    "v_daily": (
        (),
        "SELECT CAST(o.o_orderdate AS DATE) AS date, c.c_nationkey AS cell_id, "
        "CAST(floor(c.c_nationkey / CAST(5 AS DOUBLE)) AS INT) AS row_idx, c.c_nationkey % 5 AS col_idx, "
        "avg(o.o_totalprice) / CAST(3000 AS DOUBLE) AS din, "
        "CAST(5 AS DOUBLE) + CAST(10 AS DOUBLE) * avg(o.o_totalprice) / CAST(250000 AS DOUBLE) AS sst, count(*) AS n "
        "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2, 3, 4",
    ),
    "v_scores": (
        (),
        "SELECT event_id AS pred_id, user_id AS farm_id, CAST(ts AS DATE) AS date, "
        "value / (value + CAST(30 AS DOUBLE)) AS warn, "
        "CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS y_true, value AS latency_ms, "
        "CAST(least(4, floor(5 * value / (value + CAST(30 AS DOUBLE)))) AS INT) AS stage FROM events",
    ),
    # Only for the oracles; Spark densifies with plans.frames.calendar
    "v_calendar_cells": (
        ("v_daily",),
        "SELECT d.date, c.cell_id FROM (SELECT DISTINCT date FROM v_daily) d "
        "CROSS JOIN (SELECT DISTINCT cell_id FROM v_daily) c",
    ),
    "v_dense": (
        ("v_daily", "v_calendar_cells"),
        "SELECT cc.date, cc.cell_id, CAST(floor(cc.cell_id / CAST(5 AS DOUBLE)) AS INT) AS row_idx, "
        "cc.cell_id % 5 AS col_idx, d.din, d.sst FROM v_calendar_cells cc "
        "LEFT JOIN v_daily d ON d.date = cc.date AND d.cell_id = cc.cell_id",
    ),
    # Daily farm entries; dates moved by 131 days so that both seasons occur
    "v_pack_base": (
        ("v_scores",),
        "SELECT date + INTERVAL 131 DAYS AS ts, farm_id AS gid, max(warn) AS warn, max(warn) * CAST(0.8 AS DOUBLE) AS severe, "
        "least(3, max(stage)) AS stage FROM v_scores GROUP BY 1, 2",
    ),
    "v_pack": (
        ("v_scores", "v_pack_base"),
        "SELECT CAST(ts AS DATE) AS date, gid, warn, severe, stage, "
        "greatest(CAST(0 AS DOUBLE), warn * 10 - CAST(8.9 AS DOUBLE)) AS adi_first FROM v_pack_base",
    ),
}


def cte(*names: str) -> str:
    """``WITH`` clause holding the named views and what they use."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for needed in _VIEWS[name][0]:
            add(needed)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    return "WITH " + ", ".join(f"{n} AS ({_VIEWS[n][1]})" for n in wanted) + " "


def cte_recursive(*names: str) -> str:
    return cte(*names).replace("WITH ", "WITH RECURSIVE ", 1)


_BASES = ("events", "customer", "supplier", "lineitem", "orders")


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The binding view as a DataFrame over the given tables."""
    sql = _VIEWS[name][1]
    used = {}
    for base in _BASES:
        for lead in ("FROM ", "JOIN "):
            sql = sql.replace(f"{lead}{base} ", f"{lead}{{{base}}} ")
            if sql.endswith(f"{lead}{base}"):
                sql = sql[: -len(base)] + f"{{{base}}}"
        if f"{{{base}}}" in sql:
            used[base] = table(spark, d, base)
    for other in _VIEWS[name][0]:
        if f"FROM {other}" in sql:
            sql = sql.replace(f"FROM {other}", f"FROM {{{other}}}")
            used[other] = view(spark, d, other)
    return spark.sql(sql, **used)


def dense_daily(spark: SparkSession, d: str) -> DataFrame:
    """Every (date, cell) of the calendar with its reading, if any."""
    from ..plans.frames import calendar, staged

    daily = staged(view(spark, d, "v_daily"), "daily")  # read for dates, cells and values
    cells = calendar(daily, ["cell_id"])
    return cells.join(daily.select("date", "cell_id", "din", "sst"), ["date", "cell_id"], "left").select(
        "date", "cell_id", F.floor(F.col("cell_id") / 5).cast("int").alias("row_idx"),
        (F.col("cell_id") % 5).alias("col_idx"), "din", "sst",
    )


# Events inside the range of the given dates
EVENTS = [
    ("1995-11-01", "1996-02-29"),
    ("1997-01-01", "1997-02-28"),
    ("1998-11-01", "1999-02-28"),
    ("2000-11-15", "2001-01-31"),
]
EVENT_VALUES = ", ".join(f"({i}, DATE '{s}', DATE '{e}')" for i, (s, e) in enumerate(EVENTS))
BOX = (34.0, 36.8, 125.3, 128.0)


def day(column: str = "date"):
    """Dates leave the queries as ISO text, which both engines print alike."""
    return F.col(column).cast("string").alias(column)


def r6(column, name: str | None = None):
    """Derived doubles are compared at six decimals."""
    c = F.col(column) if isinstance(column, str) else column
    out = round_half_up(c, 6) + F.lit(0.0)
    return out.alias(name or column) if (name or isinstance(column, str)) else out
