"""Binning, interpolation, the channel cube and normalisation statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions import optics
from ..operators import cube as cb
from ..operators import spatial as sp
from ..operators.interpolation import Grid, interpolate_spans
from ..operators.temporal import first_in_window_spans
from .base import BOX, EVENT_VALUES, EVENTS, cte_recursive, cte, day, dense_daily, query, r6, table, view

_OBS_AT = ", p AS (SELECT o.*, s.lat, s.lon FROM v_station_obs o JOIN v_stations s USING (station_id))"


def located_obs(spark, d):
    """Observations with the position of their station."""
    stations = view(spark, d, "v_stations").select("station_id", "lat", "lon")
    return view(spark, d, "v_station_obs").join(stations, "station_id")


@query(
    "bin_mean",
    cte("v_stations", "v_station_obs") + _OBS_AT + " SELECT CAST(obs_date AS VARCHAR) AS obs_date, round(round_even(lat * 20, 0) / 20, 6) AS lat, round(round_even(lon * 20, 0) / 20, 6) AS lon, round(avg(din_ugl), 6) AS din_ugl FROM p GROUP BY obs_date, round_even(lat * 20, 0) / 20, round_even(lon * 20, 0) / 20",
)
def bin_mean(spark, d):
    b = sp.bin_mean(located_obs(spark, d), ["din_ugl"], "obs_date")
    return b.select(day("obs_date"), r6("lat"), r6("lon"), r6("din_ugl"))


@query(
    "daily_median_composite",
    cte("v_stations", "v_station_obs") + _OBS_AT + """, h AS (SELECT obs_date AS date, l_orderkey % 24 AS hour, lat, lon, water_temp FROM p), dd AS (SELECT date, bool_or(hour BETWEEN 3 AND 20) AS has FROM h GROUP BY 1),
    k AS (SELECT h.date, round(lat, 2) AS lat, round(lon, 2) AS lon, water_temp FROM h JOIN dd USING (date) WHERE (hour BETWEEN 3 AND 20 OR NOT has) AND water_temp IS NOT NULL),
    m AS (SELECT date, lat, lon, quantile_cont(water_temp, 0.5) AS v FROM k GROUP BY 1, 2, 3), n AS (SELECT *, count(*) OVER (PARTITION BY date) AS n_cells FROM m)
    SELECT CAST(date AS VARCHAR) AS date, lat, lon, round(v, 6) AS water_temp, n_cells FROM n WHERE n_cells >= 10""",
)
def daily_median_composite(spark, d):
    pixels = located_obs(spark, d).select(
        F.col("obs_date").alias("date"), (F.col("l_orderkey") % 24).alias("hour"), "lat", "lon", "water_temp"
    )
    c = sp.daily_median_composite(pixels, "water_temp", hours=(3, 20))
    return c.select(day(), "lat", "lon", r6("water_temp"), "n_cells")


@query(
    "scene_composite",
    cte("v_stations", "v_station_obs") + _OBS_AT + """, j AS (SELECT obs_date AS date, lat + dip_ugl / 10000 AS lat, lon + dip_ugl / 10000 AS lon, salinity FROM p)
    SELECT CAST(min(date) AS VARCHAR) AS date, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, round(quantile_cont(salinity, 0.5), 6) AS salinity FROM j GROUP BY round(lat, 2), round(lon, 2)""",
)
def scene_composite(spark, d):
    jitter = F.col("dip_ugl") / 10000
    points = located_obs(spark, d).select(
        F.col("obs_date").alias("date"), (F.col("lat") + jitter).alias("lat"), (F.col("lon") + jitter).alias("lon"), "salinity"
    )
    return sp.scene_composite(points, "salinity").select(day(), r6("lat"), r6("lon"), r6("salinity"))


@query(
    "scene_filter",
    """WITH x AS (SELECT event_id, CAST(ts AS DATE) AS date, (CAST(json_extract(props, '$.k') AS BIGINT) * 8 + user_id) AS flag, value FROM events), g AS (SELECT date FROM x GROUP BY 1 HAVING avg(CASE WHEN (flag & 807) = 0 THEN 1.0 ELSE 0.0 END) >= 0.01 AND avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END) >= 0.8)
    SELECT event_id, CAST(date AS VARCHAR) AS date FROM x JOIN g USING (date)""",
)
def scene_filter(spark, d):
    pixels = table(spark, d, "events").select(
        "event_id", F.col("ts").cast("date").alias("date"), (F.get_json_object("props", "$.k").cast("bigint") * 8 + F.col("user_id")).alias("flag"), "value"
    )
    kept = sp.keep_scenes(pixels, "date", optics.clear_pixel(F.col("flag")), F.col("value") > 10, 0.01, 0.8)
    return kept.select("event_id", day())


@query(
    "spatial_gradient",
    cte("v_dense") + """, f AS (SELECT date, row_idx, col_idx, coalesce(sst, avg(sst) OVER (PARTITION BY date)) AS v FROM v_dense),
    n AS (SELECT *, lag(v) OVER r AS xl, lead(v) OVER r AS xr, lag(v) OVER c AS yl, lead(v) OVER c AS yr FROM f WINDOW r AS (PARTITION BY date, row_idx ORDER BY col_idx), c AS (PARTITION BY date, col_idx ORDER BY row_idx)),
    g AS (SELECT date, row_idx, col_idx, coalesce((xr - xl) / 2.0, xr - v, v - xl, 0) AS gx, coalesce((yr - yl) / 2.0, yr - v, v - yl, 0) AS gy FROM n)
    SELECT CAST(date AS VARCHAR) AS date, row_idx, col_idx, round(sqrt(gx * gx + gy * gy), 6) AS gradient FROM g""",
)
def spatial_gradient(spark, d):
    g = sp.spatial_gradient(dense_daily(spark, d), "sst")
    return g.select(day(), "row_idx", "col_idx", r6("gradient"))


_GRID8 = "g AS (SELECT CAST(i // 8 AS INT) AS row_idx, CAST(i % 8 AS INT) AS col_idx, CAST(34 AS DOUBLE) + (i // 8) * CAST({dy!r} AS DOUBLE) AS glat, CAST(125.3 AS DOUBLE) + (i % 8) * CAST({dx!r} AS DOUBLE) AS glon FROM (SELECT unnest(range(64)) AS i))".format(
    dy=(36.8 - 34.0) / 7, dx=(128.0 - 125.3) / 7
)


@query(
    "idw_grid",
    cte("v_daily", "v_stations", "v_station_obs") + f""", t AS (SELECT DISTINCT date FROM v_daily), {_GRID8},
    o AS (SELECT station_id, obs_date, l_linenumber % 2 AS rk, min(salinity) AS v FROM v_station_obs GROUP BY 1, 2, 3),
    w AS (SELECT t.date, o.station_id, o.v, row_number() OVER (PARTITION BY t.date, o.station_id ORDER BY rk, o.obs_date, o.v) AS k FROM t JOIN o ON o.obs_date BETWEEN t.date - 7 AND t.date + 7),
    c AS (SELECT w.date, row_idx, col_idx, w.v, sqrt((glat - s.lat) * (glat - s.lat) + (glon - s.lon) * (glon - s.lon)) AS dist, w.station_id FROM w JOIN v_stations s USING (station_id) CROSS JOIN g WHERE k = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY date, row_idx, col_idx ORDER BY dist, station_id) AS rn FROM c)
    SELECT CAST(date AS VARCHAR) AS date, row_idx, col_idx, round(sum(v / pow(greatest(dist, 1e-6), 2)) / sum(1 / pow(greatest(dist, 1e-6), 2)), 6) AS value, count(*) AS n_points FROM r WHERE rn <= 10 GROUP BY 1, 2, 3""",
)
def idw_grid(spark, d):
    """Salinity on an 8 x 8 grid for every date, from the readings of the surrounding week."""
    dates = view(spark, d, "v_daily").select("date").distinct()
    points = located_obs(spark, d).select(
        F.col("station_id").alias("loc_id"), "lat", "lon", F.col("obs_date").alias("date"),
        (F.col("l_linenumber") % 2).alias("source_rank"), F.col("salinity").alias("value"),
    )
    spans = first_in_window_spans(points, ["loc_id", "lat", "lon"], 7).withColumn("channel", F.lit("value"))
    first, last = dates.agg(F.min("date"), F.max("date")).first()
    out = interpolate_spans(spans, first, last, Grid(BOX, 8, 8), ["value"], counted=True).join(dates, "date", "left_semi")
    return out.filter("n_value > 0").select(day(), "row_idx", "col_idx", r6("value"), F.col("n_value").alias("n_points"))


# measure, line numbers that carry it, expression over v_station_obs
_MEASURES = [
    ("water_temp", (1, 2), "water_temp"), ("salinity", (1, 2), "salinity"), ("dissolved_oxygen", (1, 2), "dissolved_oxygen"),
    ("no3_nitrogen", (2,), "din_ugl * CAST(0.8 AS DOUBLE)"), ("nh4_nitrogen", (2,), "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE din_ugl * CAST(0.2 AS DOUBLE) END"), ("dip", (2,), "dip_ugl"),
    ("sio2", (2,), "din_ugl / 4"), ("ph", (2,), "7 + dip_ugl / 100"), ("turbidity", (2,), "dip_ugl / 3"), ("chlorophyll_a", (2,), "salinity / 10"),
    ("precipitation_mm", (3,), "dip_ugl / 20"), ("solar_radiation_mjm2", (3,), "din_ugl / 20"), ("avg_wind_speed", (3,), "dissolved_oxygen"),
    ("wind_dir_deg", (3,), "din_ugl"), ("avg_temp", (3,), "salinity / 2"),
    ("current_u", (4,), "dissolved_oxygen / 10"), ("current_v", (4,), "dip_ugl / 30"), ("mld", (4,), "din_ugl / 6"),
    ("nir_idx", (5,), "dip_ugl / 33"),
]


def _rank(line: int) -> int:
    return line - 1


# The oracle names measures and channels by number, which keeps its intermediate tables small
_MEASURE_NO = {m: i for i, m in enumerate([*[m[0] for m in _MEASURES], "wind_dir_sin", "wind_dir_cos"])}


def _measure_sql() -> str:
    parts = []
    for name, lines, expr in _MEASURES:
        for line in lines:
            parts.append(f"SELECT station_id, obs_date, {_rank(line)} AS rk, {_MEASURE_NO[name]} AS measure, {expr} AS v FROM v_station_obs WHERE l_linenumber = {line}")
    for name, fn in (("wind_dir_sin", "sin"), ("wind_dir_cos", "cos")):
        parts.append(f"SELECT station_id, obs_date, 2, {_MEASURE_NO[name]}, {fn}(radians(din_ugl)) FROM v_station_obs WHERE l_linenumber = 3")
    return " UNION ALL ".join(parts)


_RULES = ", ".join(f"({i}, {_MEASURE_NO[m]}, {min(r)}, {max(r)}, {tol})" for i, (m, r, tol) in enumerate(cb.RAW_CHANNELS.values()))
_RAW = ", ".join(f"max(CASE WHEN channel = {i} THEN v END) AS {c}" for i, c in enumerate(cb.RAW_CHANNELS))
# Stations by distance as one list per cell, values by station as one list per day and channel: a cell takes the first ten that are there
_CUBE = (
    cte_recursive("v_stations", "v_station_obs") + f""", {_GRID8}, raw AS MATERIALIZED ({_measure_sql()}),
 t AS MATERIALIZED (SELECT CAST(unnest(generate_series(min(obs_date), max(obs_date), INTERVAL 1 DAY)) AS DATE) AS date FROM raw WHERE v IS NOT NULL),
 once AS (SELECT station_id, obs_date, rk, measure, min(v) AS v FROM raw WHERE v IS NOT NULL GROUP BY 1, 2, 3, 4), rules(channel, measure, r0, r1, tol) AS (VALUES {_RULES}),
 s AS MATERIALIZED (SELECT station_id, lat, lon, row_number() OVER (ORDER BY station_id) AS no FROM v_stations WHERE station_id IN (SELECT station_id FROM once)),
 a AS MATERIALIZED (SELECT c.channel, c.tol, o.station_id, o.obs_date, o.v, CAST(o.rk AS BIGINT) * 1000000 + (o.obs_date - DATE '1970-01-01') AS pick FROM rules c JOIN once o ON o.measure = c.measure AND o.rk BETWEEN c.r0 AND c.r1),
 w AS MATERIALIZED (SELECT channel, station_id, v, pick, unnest(range(CAST(obs_date - DATE '1970-01-01' - tol AS BIGINT), CAST(obs_date - DATE '1970-01-01' + tol + 1 AS BIGINT))) AS dn FROM a),
 f AS MATERIALIZED (SELECT DATE '1970-01-01' + CAST(dn AS INTEGER) AS date, channel, station_id, arg_min(v, pick) AS v FROM w GROUP BY dn, channel, station_id),
 near AS MATERIALIZED (SELECT row_idx, col_idx, list(no ORDER BY dist, no) AS nos, list(1 / pow(greatest(dist, 1e-6), 2) ORDER BY dist, no) AS ws
   FROM (SELECT row_idx, col_idx, s.no, sqrt((glat - s.lat) * (glat - s.lat) + (glon - s.lon) * (glon - s.lon)) AS dist FROM s CROSS JOIN g) GROUP BY 1, 2),
 l AS MATERIALIZED (SELECT k.date, k.channel, list(f.v ORDER BY s.no) AS vs FROM (SELECT DISTINCT date, channel FROM f) k CROSS JOIN s LEFT JOIN f ON f.date = k.date AND f.channel = k.channel AND f.station_id = s.station_id GROUP BY 1, 2),
 x AS (SELECT date, channel, row_idx, col_idx, list_slice(list_filter(list_zip(list_transform(nos, lambda n: vs[n]), ws), lambda e: e[1] IS NOT NULL), 1, 10) AS p FROM l CROSS JOIN near),
 i AS MATERIALIZED (SELECT date, channel, row_idx, col_idx, list_sum(list_transform(p, lambda e: e[1] * e[2])) / list_sum(list_transform(p, lambda e: e[2])) AS v FROM x),
 wide0 AS MATERIALIZED (SELECT t.date, g.row_idx, g.col_idx, {_RAW} FROM t CROSS JOIN g LEFT JOIN i ON i.date = t.date AND i.row_idx = g.row_idx AND i.col_idx = g.col_idx GROUP BY 1, 2, 3),
 wide AS (SELECT * REPLACE (coalesce(precipitation, 0) AS precipitation), CASE WHEN no3_nitrogen IS NOT NULL OR nh4_nitrogen IS NOT NULL THEN coalesce(no3_nitrogen, 0) + coalesce(nh4_nitrogen, 0) END AS din,
   sin(2 * pi() * (month(date) - 1) / 12) AS month_sin, cos(2 * pi() * (month(date) - 1) / 12) AS month_cos, sqrt(current_u * current_u + current_v * current_v) AS current_speed, row_number() OVER c AS p,
   avg(sst) OVER (c ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS sst_7d_avg, avg(sst) OVER (c ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS sst_30d_avg, avg(chlorophyll_a) OVER (c ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS chl_7d_avg,
   avg(nir_idx) OVER (c ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS nir_7d_avg, coalesce(sst, avg(sst) OVER (PARTITION BY date)) AS sf FROM wide0 WINDOW c AS (PARTITION BY row_idx, col_idx ORDER BY date)),
 z AS (SELECT *, CASE WHEN dip > 0 THEN din / dip END AS np_ratio, sst - sst_30d_avg AS sst_anomaly, p - last_value(CASE WHEN precipitation > 0.5 OR p = 1 THEN p END IGNORE NULLS) OVER (PARTITION BY row_idx, col_idx ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS days_since_rain,
   lag(sf) OVER rr AS xl, lead(sf) OVER rr AS xr, lag(sf) OVER cc AS yl, lead(sf) OVER cc AS yr FROM wide WINDOW rr AS (PARTITION BY date, row_idx ORDER BY col_idx), cc AS (PARTITION BY date, col_idx ORDER BY row_idx)),
 y AS MATERIALIZED (SELECT *, sqrt(pow(coalesce((xr - xl) / 2.0, xr - sf, sf - xl, 0), 2) + pow(coalesce((yr - yl) / 2.0, yr - sf, sf - yl, 0), 2)) AS sst_gradient FROM z) """
)
_FILLED = (
    _CUBE + ", h AS (SELECT date, row_idx, col_idx, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER c AS {c}" for c in fx.CHANNELS)
    + " FROM y WINDOW c AS (PARTITION BY row_idx, col_idx ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), mm AS (SELECT "
    + ", ".join(f"avg({c}) AS {c}" for c in fx.CHANNELS) + " FROM h), u AS MATERIALIZED (SELECT date, row_idx, col_idx, "
    + ", ".join(f"coalesce(h.{c}, mm.{c}, 0) AS {c}" for c in fx.CHANNELS) + " FROM h CROSS JOIN mm) "
)
_ROUNDED = "CAST(date AS VARCHAR) AS date, row_idx, col_idx, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in fx.CHANNELS)


def _measures(spark, d):
    """Long table of all measures, one row per reading and measure."""
    obs = located_obs(spark, d)
    entries = []
    for name, lines, expr in _MEASURES:
        value = F.when(F.col("l_linenumber").isin(*lines), F.expr(expr))
        entries.append(F.struct(F.lit(name).alias("measure"), value.cast("double").alias("value")))
    return obs.select(
        F.col("station_id").alias("loc_id"), "lat", "lon", F.col("obs_date").alias("date"),
        (F.col("l_linenumber") - 1).alias("source_rank"), F.inline(F.array(*entries)),
    ).filter(F.col("value").isNotNull())


def _cube(spark, d):
    return cb.channel_cube(_measures(spark, d), Grid(BOX, 8, 8))


@query("channel_cube", _CUBE + f"SELECT {_ROUNDED} FROM y")
def channel_cube(spark, d):
    """All 32 channels on an 8 x 8 grid for every day from the first reading to the last."""
    return _cube(spark, d).select(day(), "row_idx", "col_idx", *[r6(c) for c in fx.CHANNELS])


@query("cube_filled", _FILLED + f"SELECT {_ROUNDED} FROM u")
def cube_filled(spark, d):
    """The cube without gaps: forward-filled per cell, the rest by channel means."""
    return cb.fill_cube(_cube(spark, d)).select(day(), "row_idx", "col_idx", *[r6(c) for c in fx.CHANNELS])


@query(
    "cube_labels",
    _FILLED + f""", e(no, s, f) AS (VALUES {EVENT_VALUES}), ev AS (SELECT DISTINCT t.date FROM t JOIN e ON t.date BETWEEN s - 14 AND f + 14),
 wt AS (SELECT date, CASE WHEN m >= 15 THEN 1.5 WHEN m >= 10 THEN 1.0 ELSE 0.7 END::DOUBLE AS weight FROM (SELECT date, coalesce(avg(sst), 12) AS m FROM u GROUP BY 1)),
 q AS (SELECT u.date, row_idx, col_idx, CASE WHEN month(u.date) >= 11 THEN year(u.date) ELSE year(u.date) - 1 END AS season, (din IS NULL OR din <= 70) AS deficit, weight FROM u JOIN wt USING (date) WHERE month(u.date) NOT IN (6, 7, 8, 9, 10)),
 o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY row_idx, col_idx, season ORDER BY date) AS k FROM q),
 walk AS (SELECT row_idx, col_idx, season, date, k, CASE WHEN deficit THEN least(10.0, weight) ELSE 0.0 END::DOUBLE AS adi FROM o WHERE k = 1
   UNION ALL SELECT o.row_idx, o.col_idx, o.season, o.date, o.k, CASE WHEN o.deficit THEN least(10.0, w.adi + o.weight) ELSE w.adi * 0.2 END::DOUBLE
   FROM walk w JOIN o ON o.row_idx = w.row_idx AND o.col_idx = w.col_idx AND o.season = w.season AND o.k = w.k + 1)
 SELECT CAST(u.date AS VARCHAR) AS date, u.row_idx, u.col_idx, round(adi, 6) AS adi, CAST(CASE WHEN month(u.date) IN (6, 7, 8, 9, 10) THEN -1 WHEN ev.date IS NULL THEN 0 WHEN adi >= 8 THEN 3 WHEN adi >= 5 THEN 2 WHEN adi >= 1 THEN 1 ELSE 0 END AS INT) AS label
 FROM u LEFT JOIN walk USING (date, row_idx, col_idx) LEFT JOIN ev ON ev.date = u.date""",
)
def cube_labels(spark, d):
    """Deficit index and label of every cell and day of the filled cube."""
    labels = cb.label_cube(cb.fill_cube(_cube(spark, d)), EVENTS)
    return labels.select(day(), "row_idx", "col_idx", r6("adi"), "label")


@query(
    "cube_stats",
    _FILLED + " SELECT channel, round(avg(value), 6) AS mean, round(stddev_pop(value) + 1e-8, 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS channel, CAST({c} AS DOUBLE) AS value FROM u" for c in fx.CHANNELS) + ") GROUP BY 1",
)
def cube_stats(spark, d):
    """Normalisation statistics of every channel of the filled cube."""
    filled = cb.fill_cube(_cube(spark, d))
    return _stats(cb.norm_stats_batch(cb.to_long(filled, ["date", "row_idx", "col_idx"], fx.CHANNELS)))


_LONG = ", l AS (SELECT date, cell_id, 'din' AS channel, din AS value FROM v_dense UNION ALL SELECT date, cell_id, 'sst', sst FROM v_dense)"


def _long(spark, d):
    return cb.to_long(dense_daily(spark, d), ["date", "cell_id"], ["din", "sst"])


def _stats(df):
    return df.select("channel", *([c for c in ["n"] if c in df.columns]), *[r6(c) for c in ("mean", "std", "min", "max")])


@query(
    "norm_stats",
    cte("v_dense") + _LONG + " SELECT channel, count(value) AS n, round(avg(value), 6) AS mean, round(greatest(sqrt(greatest(sum(value * value) / count(value) - avg(value) * avg(value), 0)), 1e-8), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM l GROUP BY 1",
)
def norm_stats(spark, d):
    return _stats(cb.norm_stats(_long(spark, d)))


@query("norm_stats_batch", cte("v_dense") + _LONG + " SELECT channel, round(avg(value), 6) AS mean, round(stddev_pop(value) + 1e-8, 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM l GROUP BY 1")
def norm_stats_batch(spark, d):
    return _stats(cb.norm_stats_batch(_long(spark, d)))


@query(
    "norm_stats_merge",
    cte("v_dense") + _LONG + ", m AS (SELECT * FROM l UNION ALL SELECT date, cell_id, 'flat', CAST(3 AS DOUBLE) FROM v_dense) SELECT channel, round(avg(value), 6) AS mean, round(CASE WHEN stddev_pop(value) <= 1e-8 THEN 1 ELSE stddev_pop(value) END, 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM m GROUP BY 1",
)
def norm_stats_merge(spark, d):
    cube = dense_daily(spark, d).withColumn("flat", F.lit(3.0))
    return _stats(cb.norm_stats_merge(cb.to_long(cube, ["date", "cell_id"], ["din", "sst", "flat"])))


@query(
    "zscore_scale",
    cte("v_dense") + _LONG + ", s AS (SELECT channel, avg(value) AS m, stddev_pop(value) AS sd FROM l GROUP BY 1) SELECT CAST(date AS VARCHAR) AS date, cell_id, channel, round((value - m) / sd, 6) AS scaled FROM l JOIN s USING (channel) WHERE value IS NOT NULL",
)
def zscore_scale(spark, d):
    long = _long(spark, d).filter(F.col("value").isNotNull())
    return cb.zscore_scale(long, cb.norm_stats(long)).select(day(), "cell_id", "channel", r6("scaled"))


@query(
    "patch_cells",
    cte("v_daily") + """, a(patch_id, r, c) AS (VALUES (0, 0, 0), (1, 1, 2), (2, 2, 1)) SELECT CAST(date AS VARCHAR) AS date, patch_id, CAST(row_idx - r AS INT) AS patch_row, CAST(col_idx - c AS INT) AS patch_col, round(sst, 6) AS sst FROM v_daily JOIN a ON row_idx BETWEEN r AND r + 2 AND col_idx BETWEEN c AND c + 2""",
)
def patch_cells(spark, d):
    from ..operators.dataset import patch_cells as patches

    p = patches(view(spark, d, "v_daily"), [(0, 0), (1, 2), (2, 1)], 3)
    return p.select(day(), "patch_id", F.col("patch_row").cast("int").alias("patch_row"), F.col("patch_col").cast("int").alias("patch_col"), r6("sst"))
