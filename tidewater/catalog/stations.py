"""Station lookups, nearest joins and regional summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions import geo
from ..functions.risk import risk_index_molar, risk_stage
from ..operators import tables as tb
from ..operators.spatial import nearest_neighbors, pixel_mapping, static_channels, with_station_km
from ..operators.temporal import last_n_per_key, latest_per_column, latest_per_key
from ..plans.ordering import exact_quantiles, join_null_safe
from ..functions.numeric import round_half_up
from .base import BOX, cte, day, query, r6, table, view

_HAVERSINE = (
    "2.0 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - f.lat) / 2.0), 2) + "
    "cos(radians(f.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - f.lon) / 2.0), 2))))"
)
_DIST2 = "(f.lat - s.lat) * (f.lat - s.lat) + (f.lon - s.lon) * (f.lon - s.lon)"
_NEAREST = f"""nearest AS (
  SELECT * FROM (
    SELECT f.farm_id, f.farm_name, f.region_id AS farm_region, f.lat, f.lon, s.station_id, s.station_name, {_DIST2} AS dist2, {_HAVERSINE} AS km,
           row_number() OVER (PARTITION BY f.farm_id ORDER BY {_DIST2}, s.station_id) AS rn
    FROM v_farms f CROSS JOIN v_stations s) WHERE rn = 1)"""


def nearest_stations(spark, d):
    farms = view(spark, d, "v_farms").select("farm_id", "farm_name", F.col("region_id").alias("farm_region"), "lat", "lon")
    stations = view(spark, d, "v_stations").select("station_id", "station_name", "lat", "lon")
    found = nearest_neighbors(farms.select("farm_id", "lat", "lon"), stations, ["farm_id"], "station_id")
    return with_station_km(found).join(farms.select("farm_id", "farm_name", "farm_region"), "farm_id")


@query("nearest_station", cte("v_farms", "v_stations") + f", {_NEAREST} SELECT farm_id, station_id, round(dist2, 9) AS dist2, round(km, 6) AS km FROM nearest")
def nearest_station(spark, d):
    return nearest_stations(spark, d).select("farm_id", "station_id", round_half_up(F.col("dist2"), 9).alias("dist2"), r6("km"))


@query(
    "nearest_farm_planar",
    cte("v_farms", "v_stations") + """SELECT station_id, farm_id, round(dist2, 9) AS dist2 FROM (
    SELECT s.station_id, f.farm_id, (s.lat - f.lat) * (s.lat - f.lat) + (s.lon - f.lon) * (s.lon - f.lon) AS dist2,
    row_number() OVER (PARTITION BY s.station_id ORDER BY (s.lat - f.lat) * (s.lat - f.lat) + (s.lon - f.lon) * (s.lon - f.lon), f.farm_id) AS rn
    FROM v_stations s CROSS JOIN v_farms f) WHERE rn = 1""",
)
def nearest_farm_planar(spark, d):
    points = view(spark, d, "v_stations").select("station_id", "lat", "lon")
    farms = view(spark, d, "v_farms").select("farm_id", "lat", "lon")
    return nearest_neighbors(points, farms, ["station_id"], "farm_id").select(
        "station_id", "farm_id", round_half_up(F.col("dist2"), 9).alias("dist2")
    )


_OBS_ORDER = ["obs_date", "l_orderkey", "l_linenumber", "l_partkey"]
_OBS_DESC = "obs_date DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC"


@query(
    "latest_at_nearest",
    cte("v_farms", "v_stations", "v_station_obs") + f""", {_NEAREST}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY {_OBS_DESC}) AS rk
    FROM v_station_obs WHERE water_temp IS NOT NULL) WHERE rk = 1),
    j AS (SELECT n.farm_id, n.station_id, n.station_name, round(n.km, 1) AS distance_km, CAST(l.obs_date AS VARCHAR) AS observed_on, l.water_temp, l.salinity, l.dissolved_oxygen,
      round(l.din_ugl / 14.007, 2) AS din, round(l.dip_ugl / 30.974, 3) AS dip,
      NOT (n.lat BETWEEN 34.1 AND 36.7 AND n.lon BETWEEN 125.4 AND 127.9) AS out_of_grid FROM nearest n JOIN latest l USING (station_id)),
    k AS (SELECT *, round(din / nullif(dip, 0), 2) AS np_ratio FROM j),
    w AS (SELECT *, least(1.0, greatest(0.0, 0.38 * greatest(0.0, 1 - din / 5) + 0.27 * greatest(0.0, (water_temp - 20) / 10) + 0.19 * greatest(0.0, 1 - np_ratio / 10)
      + 0.10 * greatest(0.0, 1 - dissolved_oxygen / 5) + 0.06 * greatest(0.0, (32 - salinity) / 4))) AS score FROM k)
    SELECT farm_id, station_id, station_name, distance_km, observed_on, round(water_temp, 6) AS water_temp, round(salinity, 6) AS salinity, round(dissolved_oxygen, 6) AS dissolved_oxygen,
    din, dip, np_ratio, out_of_grid, round(score, 6) AS score, CAST(CASE WHEN score >= 0.8 THEN 4 WHEN score >= 0.6 THEN 3 WHEN score >= 0.4 THEN 2 WHEN score >= 0.2 THEN 1 ELSE 0 END AS INT) AS stage FROM w""",
)
def latest_at_nearest(spark, d):
    obs = view(spark, d, "v_station_obs").filter(F.col("water_temp").isNotNull())
    latest = latest_per_key(obs, ["station_id"], _OBS_ORDER)
    joined = nearest_stations(spark, d).join(latest, "station_id").withColumns(
        {"din": round_half_up(F.col("din_ugl") / fx.N_ATOMIC, 2), "dip": round_half_up(F.col("dip_ugl") / fx.P_ATOMIC, 3)}
    )
    scored = joined.withColumn("np_ratio", round_half_up(F.col("din") / F.nullif(F.col("dip"), F.lit(0.0)), 2)).withColumn(
        "score", risk_index_molar(F.col("din"), F.col("water_temp"), F.col("np_ratio"), F.col("dissolved_oxygen"), F.col("salinity"))
    )
    box = (34.1, 36.7, 125.4, 127.9)
    return scored.select(
        "farm_id", "station_id", "station_name", round_half_up(F.col("km"), 1).alias("distance_km"),
        F.col("obs_date").cast("string").alias("observed_on"), r6("water_temp"), r6("salinity"), r6("dissolved_oxygen"),
        "din", "dip", "np_ratio", geo.outside_box(F.col("lat"), F.col("lon"), box).alias("out_of_grid"),
        r6("score"), risk_stage(F.col("score")).alias("stage"),
    )


@query(
    "history_last_n",
    cte("v_station_obs") + f"""SELECT station_id, CAST(obs_date AS VARCHAR) AS obs_date, recency, round(water_temp, 6) AS water_temp, round(salinity, 6) AS salinity FROM (
    SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY {_OBS_DESC}) AS recency FROM v_station_obs WHERE water_temp IS NOT NULL) WHERE recency <= 8""",
)
def history_last_n(spark, d):
    obs = view(spark, d, "v_station_obs").filter(F.col("water_temp").isNotNull())
    last = last_n_per_key(obs, ["station_id"], _OBS_ORDER, 8)
    return last.orderBy("station_id", "obs_date", F.col("recency").desc()).select(
        "station_id", day("obs_date"), F.col("recency").cast("bigint").alias("recency"), r6("water_temp"), r6("salinity")
    )


@query(
    "latest_per_column",
    cte("v_readings") + """SELECT sensor_id, arg_max(value, observed_at) FILTER (WHERE field = 'view') AS wind_speed,
    arg_max(value, observed_at) FILTER (WHERE field = 'click') AS wind_dir FROM v_readings GROUP BY 1""",
)
def latest_columns(spark, d):
    wide = view(spark, d, "v_readings").withColumns(
        {
            "wind_speed": F.when(F.col("field") == "view", F.col("value")),
            "wind_dir": F.when(F.col("field") == "click", F.col("value")),
        }
    )
    return latest_per_column(wide, ["sensor_id"], F.col("observed_at"), ["wind_speed", "wind_dir"])


@query(
    "precip_24h",
    cte("v_readings") + """SELECT sensor_id, round(coalesce(sum(value) FILTER (WHERE observed_at >= (SELECT max(observed_at) FROM v_readings) - INTERVAL 24 HOURS), 0), 6) AS precipitation_24h
    FROM v_readings GROUP BY 1""",
)
def precip_24h(spark, d):
    readings = view(spark, d, "v_readings")
    newest = readings.select(F.max("observed_at")).scalar()
    recent = F.when(F.col("observed_at") >= newest - F.expr("INTERVAL 24 HOURS"), F.col("value"))
    return readings.groupBy("sensor_id").agg(r6(F.coalesce(F.sum(recent), F.lit(0.0)), "precipitation_24h"))


@query(
    "latest_per_key",
    cte("v_readings") + "SELECT sensor_id, event_id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY observed_at DESC, event_id DESC) AS rn FROM v_readings) WHERE rn = 1",
)
def latest_reading(spark, d):
    return latest_per_key(view(spark, d, "v_readings"), ["sensor_id"], ["observed_at", "event_id"]).select(
        "sensor_id", "event_id", "field", "value"
    )


@query(
    "recent_readings",
    cte("v_readings") + "SELECT event_id, sensor_id, field, value FROM v_readings WHERE observed_at >= TIMESTAMP '2024-01-05' AND observed_at <= TIMESTAMP '2024-01-25' ORDER BY observed_at DESC, event_id DESC LIMIT 500",
)
def recent_readings(spark, d):
    lo, hi = F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-25").cast("timestamp_ntz")
    r = view(spark, d, "v_readings").filter(F.col("observed_at").between(lo, hi))
    return r.orderBy(F.desc("observed_at"), F.desc("event_id")).limit(500).select("event_id", "sensor_id", "field", "value")


@query(
    "readings_between",
    cte("v_readings") + "SELECT event_id, sensor_id, field, value FROM v_readings WHERE observed_at >= TIMESTAMP '2024-01-10' AND observed_at <= TIMESTAMP '2024-01-20'",
)
def readings_between(spark, d):
    lo, hi = F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz")
    r = view(spark, d, "v_readings")
    return r.filter((F.col("observed_at") >= lo) & (F.col("observed_at") <= hi)).select("event_id", "sensor_id", "field", "value")


@query("roi_filter", cte("v_farms") + "SELECT farm_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM v_farms WHERE lat BETWEEN 34.5 AND 36.0 AND lon BETWEEN 126.0 AND 127.5")
def roi_filter(spark, d):
    f = view(spark, d, "v_farms").filter(F.col("lat").between(34.5, 36.0) & F.col("lon").between(126.0, 127.5))
    return f.select("farm_id", r6("lat"), r6("lon"))


@query(
    "region_summary",
    cte("v_farms") + """SELECT region_id, count(*) AS n, round(avg(lat), 6) AS lat_c, round(avg(lon), 6) AS lon_c, round(min(lat), 6) AS lat_min, round(max(lat), 6) AS lat_max,
    round(min(lon), 6) AS lon_min, round(max(lon), 6) AS lon_max FROM v_farms GROUP BY 1 HAVING count(*) >= 8""",
)
def region_summary(spark, d):
    g = view(spark, d, "v_farms").groupBy("region_id").agg(
        F.count("*").alias("n"), r6(F.avg("lat"), "lat_c"), r6(F.avg("lon"), "lon_c"), r6(F.min("lat"), "lat_min"),
        r6(F.max("lat"), "lat_max"), r6(F.min("lon"), "lon_min"), r6(F.max("lon"), "lon_max"),
    )
    return g.filter(F.col("n") >= 8).orderBy(F.desc("n"), "region_id")


@query(
    "region_bbox_pct",
    cte("v_farms") + """SELECT region_id, round(CASE WHEN count(*) >= 10 THEN quantile_cont(lat, 0.1) ELSE min(lat) END, 6) AS lat_lo, round(CASE WHEN count(*) >= 10 THEN quantile_cont(lat, 0.9) ELSE max(lat) END, 6) AS lat_hi,
    round(CASE WHEN count(*) >= 10 THEN quantile_cont(lon, 0.1) ELSE min(lon) END, 6) AS lon_lo, round(CASE WHEN count(*) >= 10 THEN quantile_cont(lon, 0.9) ELSE max(lon) END, 6) AS lon_hi FROM v_farms GROUP BY 1""",
)
def region_bbox_pct(spark, d):
    farms = view(spark, d, "v_farms")
    ranges = farms.groupBy("region_id").agg(
        F.count("*").alias("n"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max")
    )
    lat = exact_quantiles(farms, ["region_id"], "lat", {"lat_p10": 0.1, "lat_p90": 0.9})
    lon = exact_quantiles(farms, ["region_id"], "lon", {"lon_p10": 0.1, "lon_p90": 0.9})
    enough = F.col("n") >= 10
    pick = lambda q, full, name: r6(F.when(enough, F.col(q)).otherwise(F.col(full)), name)
    whole = join_null_safe(join_null_safe(ranges, lat, ["region_id"], "left"), lon, ["region_id"], "left")
    return whole.select(
        "region_id", pick("lat_p10", "lat_min", "lat_lo"), pick("lat_p90", "lat_max", "lat_hi"),
        pick("lon_p10", "lon_min", "lon_lo"), pick("lon_p90", "lon_max", "lon_hi"),
    )


@query("region_groups", cte("v_farms") + "SELECT region_id, farm_id, count(*) OVER (PARTITION BY region_id) AS group_size FROM v_farms")
def region_groups(spark, d):
    return tb.group_members(view(spark, d, "v_farms"), "region_id", "farm_id")


@query(
    "zone_codes",
    cte("v_farms") + """, p AS (SELECT farm_id, region_id, row_number() OVER (PARTITION BY region_id ORDER BY lat DESC, lon, farm_id) - 1 AS i FROM v_farms),
    q AS (SELECT farm_id, region_id, i, i // 9 AS z FROM p)
    SELECT farm_id, region_id, CASE WHEN z < 26 THEN chr(CAST(65 + z AS INT)) WHEN z < 702 THEN chr(CAST(65 + (z - 26) // 26 AS INT)) || chr(CAST(65 + (z - 26) % 26 AS INT))
      ELSE chr(CAST(65 + (z - 702) // 676 AS INT)) || chr(CAST(65 + ((z - 702) // 26) % 26 AS INT)) || chr(CAST(65 + (z - 702) % 26 AS INT)) END || '-' || lpad(CAST(i % 9 + 1 AS VARCHAR), 2, '0') AS zone FROM q""",
)
def zone_codes(spark, d):
    return tb.zone_codes(view(spark, d, "v_farms"), "region_id", "farm_id").select("farm_id", "region_id", "zone")


@query(
    "dup_labels",
    """SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || ' #' || CAST(row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS VARCHAR) ELSE p_name END AS label FROM part""",
)
def dup_labels(spark, d):
    return tb.duplicate_labels(table(spark, d, "part"), "p_name", "p_partkey").select("p_partkey", "label")


@query(
    "pixel_mapping",
    cte("v_farms") + """SELECT farm_id, CAST(greatest(0, least(127, floor((lat - 34.1) / (36.7 - 34.1) * 128.0))) AS INT) AS row_idx,
    CAST(greatest(0, least(127, floor((lon - 125.4) / (127.9 - 125.4) * 128.0))) AS INT) AS col_idx,
    NOT (lat BETWEEN 34.1 AND 36.7 AND lon BETWEEN 125.4 AND 127.9) AS out_of_grid FROM v_farms""",
)
def pixel(spark, d):
    return pixel_mapping(view(spark, d, "v_farms"), (34.1, 36.7, 125.4, 127.9), 128, 128).select(
        "farm_id", "row_idx", "col_idx", "out_of_grid"
    )


@query(
    "static_channels",
    cte("v_farms") + """, g AS (SELECT farm_id, lat, lon, sqrt(pow((lat - 36.02) * 111.0, 2) + pow((lon - 126.83) * 111.0 * cos(radians(lat)), 2)) AS km FROM v_farms)
    SELECT farm_id, round(km, 6) AS dist_estuary_km, round(greatest(5.0, least(100.0, 20.0 + km * 0.1)), 6) AS water_depth_m FROM g""",
)
def static(spark, d):
    return static_channels(view(spark, d, "v_farms")).select("farm_id", r6("dist_estuary_km"), r6("water_depth_m"))


@query(
    "fn_geo",
    cte("v_farms", "v_stations") + """SELECT f.farm_id, round(2.0 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(36.02 - lat) / 2.0), 2) + cos(radians(lat)) * cos(radians(36.02)) * pow(sin(radians(126.83 - lon) / 2.0), 2)))), 6) AS estuary_gc_km,
    round(sqrt(pow((lat - 36.02) * 111.0, 2) + pow((lon - 126.83) * 111.0 * cos(radians(lat)), 2)), 6) AS estuary_km,
    CAST(greatest(0, least(63, floor((lat - CAST(34 AS DOUBLE)) / (CAST(36.8 AS DOUBLE) - CAST(34 AS DOUBLE)) * 64.0))) AS INT) AS row64,
    CAST(greatest(0, least(63, floor((CAST(36.8 AS DOUBLE) - lat) / (CAST(36.8 AS DOUBLE) - CAST(34 AS DOUBLE)) * 64.0))) AS INT) AS row64_north_up,
    round(34.0 + 7 * ((36.8 - 34.0) / 63), 6) AS lat_of_row_7 FROM v_farms f""",
)
def fn_geo(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    return view(spark, d, "v_farms").select(
        "farm_id",
        r6(geo.great_circle_km(lat, lon, F.lit(fx.ESTUARY[0]), F.lit(fx.ESTUARY[1])), "estuary_gc_km"),
        r6(geo.estuary_km(lat, lon), "estuary_km"),
        geo.pixel_index(lat, BOX[0], BOX[1], 64).alias("row64"),
        geo.pixel_index(lat, BOX[0], BOX[1], 64, descending=True).alias("row64_north_up"),
        r6(geo.grid_coordinate(F.lit(7), BOX[0], BOX[1], 64), "lat_of_row_7"),
    )
