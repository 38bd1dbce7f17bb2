"""Projections, dimension joins, searches and request accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governance as gv
from ..operators import tables as tb
from .base import cte, query, r6, table, view


@query(
    "field_map",
    cte("v_station_obs") + "SELECT l_orderkey, l_linenumber, l_partkey, station_id, round(coalesce(water_temp, salinity), 6) AS temperature, round(din_ugl, 6) AS din, CAST(NULL AS DOUBLE) AS chlorophyll FROM v_station_obs",
)
def field_map(spark, d):
    mapping = {"temperature": ["wtemS", "water_temp", "salinity"], "din": ["din_ugl", "dip_ugl"], "chlorophyll": ["clrpla"]}
    m = tb.field_map(view(spark, d, "v_station_obs"), mapping, ["l_orderkey", "l_linenumber", "l_partkey", "station_id"])
    return m.withColumns({"temperature": r6("temperature"), "din": r6("din")})


@query("area_filter", cte("v_farms") + "SELECT farm_id, region_id FROM v_farms WHERE region_id IN (3, 7, 11, 19)")
def area_filter(spark, d):
    return view(spark, d, "v_farms").filter(F.col("region_id").isin(3, 7, 11, 19)).select("farm_id", "region_id")


@query(
    "token_search",
    "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 're') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1') AND starts_with(p_type, 'EC') ORDER BY p_partkey LIMIT 300",
)
def token_search(spark, d):
    """Token-AND search with the 300-row cap of the picker, restricted by a two-letter prefix."""
    parts = table(spark, d, "part").filter(F.col("p_type").startswith("EC"))
    hay = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return tb.token_search(parts, "Re  BRAND#1", hay, 300, [F.col("p_partkey")]).select("p_partkey", "p_name")


@query(
    "station_enrich",
    cte("v_stations", "v_station_obs") + "SELECT l_orderkey, l_linenumber, l_partkey, station_id, round(s.lat, 6) AS lat, round(s.lon, 6) AS lon FROM v_station_obs JOIN v_stations s USING (station_id) WHERE s.region_id <> 7",
)
def station_enrich(spark, d):
    known = view(spark, d, "v_stations").filter("region_id <> 7").select("station_id", "lat", "lon")
    return view(spark, d, "v_station_obs").join(known, "station_id").select("l_orderkey", "l_linenumber", "l_partkey", "station_id", r6("lat"), r6("lon"))


@query(
    "fuzzy_name_join",
    """WITH names AS (SELECT n_name AS known_name, n_nationkey AS rank FROM nation), asked AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'NATION_' || CAST(c_nationkey AS VARCHAR) WHEN 1 THEN 'area NATION_' || CAST(c_nationkey AS VARCHAR) || ' bay' WHEN 2 THEN 'ATION_' || CAST(c_nationkey AS VARCHAR) ELSE 'site ' || CAST(c_nationkey AS VARCHAR) END AS name FROM customer),
    hit AS (SELECT c_custkey, name, rank, CASE WHEN name = known_name THEN 0 ELSE 1 END AS loose FROM asked JOIN names ON contains(name, known_name) OR contains(known_name, name)), b AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY loose, rank) AS rn FROM hit)
    SELECT a.c_custkey, a.name, b.rank AS nation FROM asked a LEFT JOIN b ON b.c_custkey = a.c_custkey AND rn = 1""",
)
def fuzzy_name_join(spark, d):
    names = table(spark, d, "nation").select(F.col("n_name").alias("known_name"), F.col("n_nationkey").alias("rank"), F.col("n_nationkey").alias("nation"))
    key = F.col("c_nationkey").cast("string")
    kind = F.col("c_custkey") % 4
    name = (
        F.when(kind == 0, F.concat(F.lit("NATION_"), key)).when(kind == 1, F.concat(F.lit("area NATION_"), key, F.lit(" bay")))
        .when(kind == 2, F.concat(F.lit("ATION_"), key)).otherwise(F.concat(F.lit("site "), key))
    )
    asked = table(spark, d, "customer").select("c_custkey", name.alias("name"))
    return tb.fuzzy_name_join(asked, names, "name").select("c_custkey", "name", "nation")


@query(
    "patch_left_join",
    cte("v_farms", "v_stations") + """, s AS (SELECT round(lat, 6) AS la, round(lon, 6) AS lo, min(station_id) AS mld FROM v_stations GROUP BY 1, 2)
    SELECT farm_id, s.mld, round((SELECT avg(CASE WHEN s2.mld IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM v_farms f2 LEFT JOIN s s2 ON s2.la = round(f2.lat, 6) AND s2.lo = round(f2.lon, 6)), 6) AS fill_ratio FROM v_farms f LEFT JOIN s ON s.la = round(f.lat, 6) AND s.lo = round(f.lon, 6)""",
)
def patch_left_join(spark, d):
    farms = view(spark, d, "v_farms")
    patch = view(spark, d, "v_stations").groupBy("lat", "lon").agg(F.min("station_id").alias("mld"))
    patched = tb.patch_column(farms, patch, ["lat", "lon"], "mld")
    ratio = patched.select(r6(tb.fill_ratio(patched, "mld"), "r")).scalar()
    return patched.select("farm_id", "mld", ratio.alias("fill_ratio"))


_CATALOG = [("view", "din", "quarterly"), ("click", "water_temp", "hourly"), ("purchase", "dip", "quarterly")]
_CATALOG_SQL = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _CATALOG)


@query(
    "catalog_enrich",
    f"WITH m(source, field, frequency) AS (VALUES {_CATALOG_SQL}), s AS (SELECT event_type AS source, count(*) AS n FROM events GROUP BY 1) SELECT s.source, n, coalesce(field, 'unknown') AS field, coalesce(frequency, 'irregular') AS frequency FROM s LEFT JOIN m USING (source)",
)
def catalog_enrich(spark, d):
    meta = spark.createDataFrame(_CATALOG, "source STRING, field STRING, frequency STRING")
    status = table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n"))
    return status.join(F.broadcast(meta), "source", "left").select(
        "source", "n", F.coalesce("field", F.lit("unknown")).alias("field"), F.coalesce("frequency", F.lit("irregular")).alias("frequency")
    )


_ENDPOINT = "CASE event_type WHEN 'view' THEN '/rag/query' WHEN 'click' THEN '/predict' WHEN 'purchase' THEN '/explain' ELSE '/other' END"


def requests(spark, d):
    e = table(spark, d, "events")
    return e.select(
        "event_id", "user_id", F.expr(_ENDPOINT).alias("endpoint"), "ts",
        F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())).alias("micros"),
    )


@query(
    "request_rate",
    f"WITH r AS (SELECT event_id, user_id, {_ENDPOINT} AS endpoint, ts FROM events), w AS (SELECT *, count(*) OVER (PARTITION BY user_id, endpoint ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS in_window FROM r) "
    "SELECT event_id, in_window, CASE endpoint WHEN '/rag/query' THEN 20 WHEN '/predict' THEN 60 WHEN '/explain' THEN 30 ELSE 100 END AS \"limit\", in_window <= CASE endpoint WHEN '/rag/query' THEN 20 WHEN '/predict' THEN 60 WHEN '/explain' THEN 30 ELSE 100 END AS allowed FROM w",
)
def request_rate(spark, d):
    """Requests per user and endpoint in the six hours up to each request: a window of several slices."""
    r = gv.request_rate(requests(spark, d), ["user_id", "endpoint"], "micros", window_seconds=21_600)
    limit = gv.rate_limit(F.col("endpoint"))
    return r.select("event_id", "in_window", limit.alias("limit"), (F.col("in_window") <= limit).alias("allowed"))


@query(
    "request_usage",
    f"WITH r AS (SELECT user_id, {_ENDPOINT} AS endpoint, ts FROM events), g AS (SELECT user_id, endpoint, count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM r) - INTERVAL 2 DAYS) AS current_requests FROM r GROUP BY 1, 2) "
    "SELECT user_id, endpoint, current_requests, CASE endpoint WHEN '/rag/query' THEN 20 WHEN '/predict' THEN 60 WHEN '/explain' THEN 30 ELSE 100 END AS \"limit\", greatest(0, CASE endpoint WHEN '/rag/query' THEN 20 WHEN '/predict' THEN 60 WHEN '/explain' THEN 30 ELSE 100 END - current_requests) AS remaining FROM g",
)
def request_usage(spark, d):
    return gv.request_usage(requests(spark, d), "user_id", "endpoint", "ts", 172_800)
