"""Outlier flags and their roll-ups over readings mapped to measured fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as ql
from ..operators import tables as tb
from ..operators.cube import to_long
from ..plans.frames import staging_path
from ..sources import tables as sources
from .base import cte, dense_daily, query, r6, view

# Event types stand for measured fields
FIELDS = {"view": "din", "click": "water_temp", "purchase": "dip", "error": "dissolved_oxygen", "signup": "np_ratio"}
_FIELD_SQL = "CASE field WHEN 'view' THEN 'din' WHEN 'click' THEN 'water_temp' WHEN 'purchase' THEN 'dip' WHEN 'error' THEN 'dissolved_oxygen' ELSE 'np_ratio' END"
_R = f", r AS (SELECT event_id, sensor_id, observed_at, {_FIELD_SQL} AS field, value FROM v_readings)"
_WIN = """, s AS (SELECT *, count(value) OVER w AS win_n, avg(value) OVER w AS win_mean, stddev_pop(value) OVER w AS win_std, quantile_cont(value, 0.25) OVER w AS q1, quantile_cont(value, 0.75) OVER w AS q3,
  lag(value) OVER (PARTITION BY sensor_id ORDER BY observed_at, event_id) AS prev_value FROM r
  WINDOW w AS (PARTITION BY sensor_id ORDER BY observed_at, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
 z AS (SELECT *, CASE WHEN win_n >= 10 AND win_std > 1e-6 THEN abs(value - win_mean) / win_std END AS zs FROM s)"""
_BOUNDS = """(VALUES ('din', 0.0, 1500.0), ('water_temp', -2.0, 35.0), ('dip', 0.0, 200.0), ('dissolved_oxygen', 0.0, 20.0), ('np_ratio', 0.0, 200.0)) b(field, lo, hi)"""
_DOMAIN = """(VALUES ('din', 100.0, 70.0, -1), ('dip', 16.0, 6.0, -1), ('water_temp', 22.0, 25.0, 1), ('np_ratio', 16.0, 6.0, -1), ('dissolved_oxygen', 6.0, 4.0, -1)) d(field, caution, danger, sgn)"""
_Z = "SELECT event_id, sensor_id, field, value, 'z_score' AS anomaly_type, CASE WHEN zs > 4.5 THEN 'critical' ELSE 'warning' END AS severity, CAST(3.0 AS DOUBLE) AS threshold FROM z WHERE zs > 3"
_IQR = "SELECT event_id, sensor_id, field, value, 'iqr' AS anomaly_type, 'warning' AS severity, CAST(NULL AS DOUBLE) AS threshold FROM z WHERE win_n >= 10 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AND NOT coalesce(zs > 3, false)"
_SPIKE = "SELECT event_id, sensor_id, field, value, 'spike' AS anomaly_type, 'warning' AS severity, CAST(3.0 AS DOUBLE) AS threshold FROM z WHERE abs(prev_value) > 1e-6 AND abs(value - prev_value) / abs(prev_value) > 3"
_BOUND = f"SELECT event_id, sensor_id, r.field, value, 'physical_range' AS anomaly_type, 'critical' AS severity, CAST(CASE WHEN value > hi THEN hi ELSE lo END AS DOUBLE) AS threshold FROM r JOIN {_BOUNDS} ON b.field = r.field WHERE value < lo OR value > hi"
_DOM = f"SELECT event_id, sensor_id, r.field, value, 'domain_rule' AS anomaly_type, CASE WHEN sgn * value >= sgn * danger THEN 'critical' ELSE 'warning' END AS severity, CAST(CASE WHEN sgn * value >= sgn * danger THEN danger ELSE caution END AS DOUBLE) AS threshold FROM r JOIN {_DOMAIN} ON d.field = r.field WHERE sgn * value >= sgn * caution OR sgn * value >= sgn * danger"
_ALL = f", flags AS ({_BOUND} UNION ALL {_Z} UNION ALL {_IQR} UNION ALL {_SPIKE} UNION ALL {_DOM})"

_KEYS, _ORDER = ["sensor_id"], [("observed_at", True), ("event_id", True)]
_OUT = ["event_id", "sensor_id", "field", "value", "anomaly_type", "severity", "threshold"]


def field_readings(spark, d):
    name = F.element_at(F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv]), F.col("field"))
    return view(spark, d, "v_readings").withColumn("field", name)


def _flags(spark, d):
    return ql.flag_outliers(field_readings(spark, d), _KEYS, _ORDER)


@query("replay_outliers", cte("v_readings") + _R + _WIN + _ALL + " SELECT * FROM flags")
def replay_outliers(spark, d):
    """The same flags from an ordered replay of each sensor."""
    return ql.replay_outliers(field_readings(spark, d), _KEYS, [c for c, _ in _ORDER]).select(*_OUT)


@query("outlier_flags", cte("v_readings") + _R + _WIN + _ALL + " SELECT * FROM flags")
def outlier_flags(spark, d):
    return _flags(spark, d).select(*_OUT)


def _statistic(spark, d, kind):
    stats = ql.window_statistics(field_readings(spark, d), _KEYS, _ORDER)
    flag = ql.statistic_flags()[kind]
    return stats.withColumn("_f", flag).filter(F.col("_f").isNotNull()).select("event_id", "sensor_id", "field", "value", "_f.*")


@query("zscore_flags", cte("v_readings") + _R + _WIN + _Z)
def zscore_flags(spark, d):
    return _statistic(spark, d, "z_score")


@query("iqr_flags", cte("v_readings") + _R + _WIN + _IQR)
def iqr_flags(spark, d):
    return _statistic(spark, d, "iqr")


@query("spike_flags", cte("v_readings") + _R + _WIN + _SPIKE)
def spike_flags(spark, d):
    return _statistic(spark, d, "spike")


def _row_flag(spark, d, flag):
    r = field_readings(spark, d).withColumn("_f", flag(F.col("field"), F.col("value")))
    return r.filter(F.col("_f").isNotNull()).select("event_id", "sensor_id", "field", "value", "_f.*")


@query("bounds_flags", cte("v_readings") + _R + " " + _BOUND)
def bounds_flags(spark, d):
    return _row_flag(spark, d, ql.bounds_flag)


@query("domain_flags", cte("v_readings") + _R + " " + _DOM)
def domain_flags(spark, d):
    return _row_flag(spark, d, ql.domain_flag)


@query(
    "outlier_report",
    cte("v_readings") + _R + _WIN + _ALL + """ SELECT event_id, count(*) AS n_flags, count(*) FILTER (WHERE severity = 'critical') AS critical_count, count(*) FILTER (WHERE severity = 'warning') AS warning_count,
    CASE WHEN count(*) FILTER (WHERE severity = 'critical') > 0 THEN 'critical' ELSE 'warning' END AS max_severity FROM flags GROUP BY 1""",
)
def outlier_report(spark, d):
    return ql.outlier_report(_flags(spark, d), ["event_id"])


_FEATURE_RAW = f""", raw AS (SELECT event_id, sensor_id, observed_at, value, CASE WHEN event_id % 3 = 0 THEN 0.0 WHEN event_id % 3 = 1 THEN value END AS din_in, value * CAST(0.1 AS DOUBLE) AS no3, CASE WHEN event_id % 4 <> 0 THEN CAST(2 AS DOUBLE) END AS nh4,
   CASE WHEN event_id % 5 <> 0 THEN value / 20 ELSE 0.0 END AS dip_in, CASE WHEN event_id % 2 = 0 THEN value / 10 ELSE 0.0 END AS wt FROM v_readings),
 f AS (SELECT event_id, sensor_id, coalesce(nullif(din_in, 0), coalesce(no3, 0) + coalesce(nh4, 0)) AS din, coalesce(nullif(dip_in, 0), 20.0) AS dip, nullif(wt, 0) AS water_temp_surface FROM raw),
 g AS (SELECT *, CASE WHEN dip > 0 THEN round(din / dip, 4) ELSE 0 END AS ratio FROM f),
 sev AS (SELECT *, CASE WHEN din <= 70 OR dip <= 6 OR water_temp_surface >= 25 OR din > 1500 OR dip > 200 OR water_temp_surface > 35 OR water_temp_surface < -2 OR din < 0 OR dip < 0 THEN -1
   WHEN din <= 100 OR dip <= 16 OR water_temp_surface >= 22 THEN 0 ELSE 1 END AS quality_flag FROM g)"""


@query(
    "feature_rows",
    cte("v_readings") + _FEATURE_RAW + " SELECT event_id, sensor_id, 'v1.0' AS feature_version, round(din, 6) AS din, round(dip, 6) AS dip, ratio AS din_dip_ratio, round(water_temp_surface, 6) AS water_temp_surface, CAST(quality_flag AS INT) AS quality_flag FROM sev",
)
def feature_rows(spark, d):
    """Feature rows whose quality flag comes from the row rules (bounds and domain levels) of their own fields."""
    raw = view(spark, d, "v_readings").selectExpr(
        "event_id", "sensor_id", "CASE WHEN event_id % 3 = 0 THEN 0D WHEN event_id % 3 = 1 THEN value END AS din", "value * 0.1D AS no3_nitrogen",
        "CASE WHEN event_id % 4 <> 0 THEN 2D END AS nh4_nitrogen", "CASE WHEN event_id % 5 <> 0 THEN value / 20 ELSE 0D END AS dip",
        "CASE WHEN event_id % 2 = 0 THEN value / 10 ELSE 0D END AS water_temp",
    )
    rows = ql.feature_projection(raw).withColumn("feature_version", F.lit("v1.0"))
    checks = []
    for field, column in (("din", "din"), ("dip", "dip"), ("water_temp", "water_temp_surface")):
        for flag in (ql.bounds_flag, ql.domain_flag):
            checks.append(flag(F.lit(field), F.col(column))["severity"])
    found = F.array_compact(F.array(*checks))
    worst = F.when(F.array_contains(found, "critical"), "critical").when(F.size(found) > 0, "warning")
    return rows.select(
        "event_id", "sensor_id", "feature_version", r6("din"), r6("dip"), "din_dip_ratio", r6("water_temp_surface"),
        F.coalesce(ql.quality_flag(worst), F.lit(1)).alias("quality_flag"),
    )


@query(
    "upsert_features",
    cte("v_station_obs") + """, old AS (SELECT station_id, obs_date, 1 AS rk, max(din_ugl) AS din FROM v_station_obs WHERE l_linenumber % 2 = 0 GROUP BY 1, 2),
    new AS (SELECT station_id, obs_date, 0 AS rk, min(din_ugl) AS din FROM v_station_obs WHERE l_linenumber % 2 = 1 GROUP BY 1, 2)
    SELECT station_id, CAST(obs_date AS VARCHAR) AS feature_ts, round(din, 6) AS din FROM (SELECT *, row_number() OVER (PARTITION BY station_id, obs_date ORDER BY rk) AS rn FROM (SELECT * FROM old UNION ALL SELECT * FROM new)) WHERE rn = 1""",
)
def upsert_features(spark, d):
    obs = view(spark, d, "v_station_obs")
    keyed = lambda parity, agg: obs.filter(F.col("l_linenumber") % 2 == parity).groupBy(
        "station_id", F.col("obs_date").alias("feature_ts")
    ).agg(agg("din_ugl").alias("din"))
    return tb.upsert(keyed(0, F.max), keyed(1, F.min), ["station_id", "feature_ts"]).select(
        "station_id", F.col("feature_ts").cast("string").alias("feature_ts"), r6("din")
    )


@query(
    "upsert_partitions",
    cte("v_station_obs") + """, o AS (SELECT station_id, obs_date, year(obs_date) * 100 + month(obs_date) AS month, l_linenumber, l_orderkey, l_partkey, din_ugl FROM v_station_obs),
    old AS (SELECT month, station_id, obs_date, max(din_ugl) AS din FROM o WHERE l_linenumber % 2 = 0 GROUP BY 1, 2, 3),
    inc AS (SELECT month, station_id, obs_date, din_ugl AS din, row_number() OVER (PARTITION BY month, station_id, obs_date ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, din_ugl DESC) AS rn FROM o WHERE l_linenumber % 2 = 1 AND month % 100 = 3)
    SELECT month, station_id, CAST(obs_date AS VARCHAR) AS obs_date, round(din, 6) AS din FROM (SELECT month, station_id, obs_date, din FROM inc WHERE rn = 1 UNION ALL SELECT * FROM old WHERE NOT EXISTS (
      SELECT 1 FROM inc WHERE inc.month = old.month AND inc.station_id = old.station_id AND inc.obs_date = old.obs_date))""",
)
def upsert_partitions(spark, d):
    """A table by month into which new readings of every March are merged; the other months keep their files."""
    obs = view(spark, d, "v_station_obs").withColumn("month", F.year("obs_date") * 100 + F.month("obs_date"))
    path = staging_path(spark, "features")
    old = obs.filter("l_linenumber % 2 = 0").groupBy("month", "station_id", "obs_date").agg(F.max("din_ugl").alias("din"))
    old.write.partitionBy("month").parquet(path)
    incoming = obs.filter("l_linenumber % 2 = 1 and month % 100 = 3").select(
        "month", "station_id", "obs_date", "l_orderkey", "l_linenumber", "l_partkey", F.col("din_ugl").alias("din"))
    sources.upsert_partitions(spark, path, incoming, ["month", "station_id", "obs_date"], ["l_orderkey", "l_linenumber", "l_partkey"], "month")
    return spark.read.parquet(path).select("month", "station_id", F.col("obs_date").cast("string").alias("obs_date"), r6("din"))


@query(
    "insert_new_only",
    cte("v_station_obs") + """, old AS (SELECT DISTINCT station_id, obs_date FROM v_station_obs WHERE l_linenumber % 2 = 0),
    inc AS (SELECT *, row_number() OVER (PARTITION BY station_id, obs_date ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM v_station_obs WHERE l_linenumber % 2 = 1)
    SELECT station_id, CAST(obs_date AS VARCHAR) AS obs_date, l_orderkey, l_linenumber, l_partkey FROM inc WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM old o WHERE o.station_id = inc.station_id AND o.obs_date = inc.obs_date)""",
)
def insert_new_only(spark, d):
    obs = view(spark, d, "v_station_obs").select("station_id", "obs_date", "l_orderkey", "l_linenumber", "l_partkey")
    new = tb.insert_new_only(
        obs.filter("l_linenumber % 2 = 0"), obs.filter("l_linenumber % 2 = 1"), ["station_id", "obs_date"], ["l_orderkey", "l_linenumber", "l_partkey"]
    )
    return new.withColumn("obs_date", F.col("obs_date").cast("string"))


@query(
    "dedup_first",
    cte("v_station_obs") + """SELECT station_id, CAST(obs_date AS VARCHAR) AS obs_date, l_orderkey, l_linenumber, l_partkey FROM (
    SELECT *, row_number() OVER (PARTITION BY station_id, obs_date ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM v_station_obs) WHERE rn = 1""",
)
def dedup_first(spark, d):
    from ..operators.temporal import first_per_key

    obs = view(spark, d, "v_station_obs").select("station_id", "obs_date", "l_orderkey", "l_linenumber", "l_partkey")
    return first_per_key(obs, ["station_id", "obs_date"], ["l_orderkey", "l_linenumber", "l_partkey"]).withColumn(
        "obs_date", F.col("obs_date").cast("string")
    )


@query(
    "channel_health",
    cte("v_dense") + """, l AS (SELECT 'din' AS channel, din AS value FROM v_dense UNION ALL SELECT 'sst', sst FROM v_dense UNION ALL SELECT 'flat', CAST(0 AS DOUBLE) FROM v_dense)
    SELECT channel, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(count(*) FILTER (WHERE value = 0) * 100.0 / count(*), 6) AS zero_pct,
    round(count(*) FILTER (WHERE value IS NULL) * 100.0 / count(*), 6) AS null_pct, stddev_pop(value) < 1e-6 OR count(*) FILTER (WHERE value = 0) * 100.0 / count(*) > 90 AS dead FROM l GROUP BY 1""",
)
def channel_health(spark, d):
    cube = dense_daily(spark, d).withColumn("flat", F.lit(0.0))
    h = ql.channel_health(to_long(cube, ["date", "cell_id"], ["din", "sst", "flat"]))
    return h.select("channel", *[r6(c) for c in ("mean", "std", "min", "max", "zero_pct", "null_pct")], "dead")


@query(
    "complete_snapshots",
    cte("v_station_obs") + "SELECT l_orderkey, l_linenumber, l_partkey, station_id FROM v_station_obs WHERE water_temp IS NOT NULL AND nullif(salinity, 28.0) IS NOT NULL AND dissolved_oxygen IS NOT NULL AND din_ugl IS NOT NULL AND dip_ugl IS NOT NULL",
)
def complete_snapshots(spark, d):
    obs = view(spark, d, "v_station_obs").withColumn("salinity", F.nullif(F.col("salinity"), F.lit(28.0)))
    return obs.na.drop(subset=["water_temp", "salinity", "dissolved_oxygen", "din_ugl", "dip_ugl"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "station_id"
    )
