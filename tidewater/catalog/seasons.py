"""Daily-series operators: rolling windows, joins on dates, deficit index and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seasons as sn
from ..operators import cube as cb
from ..operators import labels as lb
from ..operators import temporal as tp
from ..functions.numeric import round_half_up
from .base import EVENT_VALUES, EVENTS, cte, cte_recursive, day, dense_daily, query, r6, view

_W = "PARTITION BY cell_id ORDER BY date"


def _cells(spark, d):
    return dense_daily(spark, d).select("date", "cell_id", "din", "sst")


@query(
    "rolling_means",
    cte("v_dense") + f"SELECT CAST(date AS VARCHAR) AS date, cell_id, round(avg(sst) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS mean_7d, round(avg(sst) OVER ({_W} ROWS BETWEEN 30 PRECEDING AND CURRENT ROW), 6) AS mean_30d FROM v_dense",
)
def rolling_means(spark, d):
    return tp.rolling_means(_cells(spark, d), ["cell_id"], "sst").select(day(), "cell_id", r6("mean_7d"), r6("mean_30d"))


@query(
    "sst_anomaly",
    cte("v_dense") + f"SELECT CAST(date AS VARCHAR) AS date, cell_id, round(sst - avg(sst) OVER ({_W} ROWS BETWEEN 30 PRECEDING AND CURRENT ROW), 6) AS anomaly FROM v_dense",
)
def sst_anomaly(spark, d):
    r = tp.rolling_means(_cells(spark, d), ["cell_id"], "sst")
    return r.select(day(), "cell_id", r6(F.col("sst") - F.col("mean_30d"), "anomaly"))


@query(
    "days_since_rain",
    cte("v_dense") + f""", n AS (SELECT *, row_number() OVER ({_W}) AS p, coalesce(din, 0) / 100 AS rain FROM v_dense)
    SELECT CAST(date AS VARCHAR) AS date, cell_id, p - last_value(CASE WHEN rain > 0.5 OR p = 1 THEN p END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS days_since_rain FROM n""",
)
def days_since_rain(spark, d):
    rain = _cells(spark, d).withColumn("rain", F.coalesce("din", F.lit(0.0)) / 100)
    return tp.days_since_rain(rain, ["cell_id"], "rain").select(day(), "cell_id", F.col("days_since_rain").cast("bigint").alias("days_since_rain"))


_FF = f"last_value(din IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("forward_fill", cte("v_dense") + f"SELECT CAST(date AS VARCHAR) AS date, cell_id, round({_FF}, 6) AS din FROM v_dense")
def forward_fill(spark, d):
    return tp.forward_fill(_cells(spark, d), ["cell_id"], ["din"]).select(day(), "cell_id", r6("din"))


@query("mean_fill", cte("v_dense") + f", f AS MATERIALIZED (SELECT date, cell_id, {_FF} AS din FROM v_dense), a AS (SELECT date, cell_id, din, avg(din) OVER () AS mean FROM f) SELECT CAST(date AS VARCHAR) AS date, cell_id, round(coalesce(din, mean, 0), 6) AS din FROM a")
def mean_fill(spark, d):
    filled = tp.mean_fill(tp.forward_fill(_cells(spark, d), ["cell_id"], ["din"]), ["din"])
    return filled.select(day(), "cell_id", r6("din"))


@query("din_diff", cte("v_daily") + f"SELECT CAST(date AS VARCHAR) AS date, cell_id, round(coalesce(din - lag(din) OVER ({_W}), 0), 6) + 0.0 AS din_diff FROM v_daily")
def din_diff(spark, d):
    return tp.lag_difference(view(spark, d, "v_daily"), ["cell_id"], "din", "din_diff").select(day(), "cell_id", r6("din_diff"))


_WEIGHT = "CASE WHEN m >= 15 THEN 1.5 WHEN m >= 10 THEN 1.0 ELSE 0.7 END"


@query(
    "deficit_windows",
    cte("v_daily") + f""", g AS (SELECT date, {_WEIGHT} AS weight FROM (SELECT date, coalesce(avg(sst), 12) AS m FROM v_daily GROUP BY 1)), s AS (SELECT d.date, cell_id, din, greatest(70 - din, 0) * weight AS sc FROM v_daily d JOIN g USING (date))
    SELECT CAST(date AS VARCHAR) AS date, cell_id, round(sum(sc) OVER ({_W} ROWS BETWEEN 28 PRECEDING AND CURRENT ROW), 4) AS deficit_30d, round(sum(sc) OVER ({_W} ROWS BETWEEN 58 PRECEDING AND CURRENT ROW), 4) AS deficit_60d FROM s""",
)
def deficit_windows(spark, d):
    f = tp.deficit_features(view(spark, d, "v_daily"), ["cell_id"])
    return f.select(day(), "cell_id", round_half_up(F.col("deficit_30d"), 4).alias("deficit_30d"), round_half_up(F.col("deficit_60d"), 4).alias("deficit_60d"))


@query(
    "change_mask",
    cte("v_dense") + f""", f AS (SELECT date, cell_id, coalesce({_FF}, 0) AS din FROM v_dense), l AS (SELECT *, lag(din) OVER ({_W}) AS p FROM f)
    SELECT CAST(date AS VARCHAR) AS date, cell_id, CAST(CASE WHEN p IS NULL OR abs(din - p) > 1e-8 + 1e-5 * abs(p) THEN 1 ELSE 0 END AS INT) AS changed FROM l""",
)
def change_mask(spark, d):
    filled = tp.forward_fill(_cells(spark, d), ["cell_id"], ["din"]).withColumn("din", F.coalesce("din", F.lit(0.0)))
    return tp.change_mask(filled, ["cell_id"], "din").select(day(), "cell_id", "changed")


@query(
    "asof_prev_3d",
    cte("v_station_obs") + """, dd AS (SELECT DISTINCT station_id, obs_date AS date FROM v_station_obs), l AS (SELECT station_id, date, lag(date) OVER (PARTITION BY station_id ORDER BY date) AS p FROM dd)
    SELECT station_id, CAST(date AS VARCHAR) AS date, CAST(CASE WHEN date - p <= 3 THEN p END AS VARCHAR) AS prev_date FROM l""",
)
def asof_prev(spark, d):
    """Previous observation date of every station, where gaps of every size occur."""
    dates = view(spark, d, "v_station_obs").select("station_id", F.col("obs_date").alias("date"))
    return tp.previous_date(dates, keys=("station_id",)).select("station_id", day(), day("prev_date"))


@query(
    "tolerance_join",
    cte("v_daily", "v_station_obs") + """, t AS (SELECT DISTINCT date FROM v_daily), p AS (SELECT obs_date, count(*) AS n, sum(salinity) AS s FROM v_station_obs GROUP BY 1)
    SELECT CAST(t.date AS VARCHAR) AS date, CAST(sum(p.n) AS BIGINT) AS n_points, round(sum(p.s) / sum(p.n), 6) AS mean_salinity, count(*) AS n_days FROM t JOIN p ON abs(t.date - p.obs_date) <= 90 GROUP BY 1""",
)
def tolerance_join(spark, d):
    """Readings within 90 days of every date; readings are reduced to one row per day before the range join."""
    targets = view(spark, d, "v_daily").select("date").distinct()
    points = view(spark, d, "v_station_obs").groupBy("obs_date").agg(F.count("*").alias("n"), F.sum("salinity").alias("s"))
    near = tp.within_days(targets, points, 90, "date", "obs_date")
    return near.groupBy("date").agg(
        F.sum("n").alias("n_points"), r6(F.sum("s") / F.sum("n"), "mean_salinity"), F.count("*").alias("n_days")
    ).withColumn("date", F.col("date").cast("string"))


@query(
    "event_interval",
    cte("v_daily") + f""", e(no, s, f) AS (VALUES {EVENT_VALUES}), t AS (SELECT DISTINCT date FROM v_daily)
    SELECT CAST(date AS VARCHAR) AS date, coalesce(bool_or(date BETWEEN s AND f), false) AS in_event, coalesce(bool_or(date BETWEEN s - 14 AND f + 14), false) AS in_buffer FROM t LEFT JOIN e ON date BETWEEN s - 14 AND f + 14 GROUP BY 1""",
)
def event_interval(spark, d):
    """Event table joined through the days it covers; kept as a left join so quiet dates stay."""
    events = spark.createDataFrame([(i, s, e) for i, (s, e) in enumerate(EVENTS)], "event_no INT, start STRING, end STRING")
    events = events.withColumns({"start": F.col("start").cast("date"), "end": F.col("end").cast("date")})
    days = view(spark, d, "v_daily").select("date").distinct()
    covered = tp.interval_events(days, events, before=14, after=14)
    per_day = covered.groupBy("date").agg(
        F.bool_or(F.col("date").between(F.col("start"), F.col("end"))).alias("in_event"), F.lit(True).alias("in_buffer")
    )
    return days.join(per_day, "date", "left").select(
        day(), F.coalesce("in_event", F.lit(False)).alias("in_event"), F.coalesce("in_buffer", F.lit(False)).alias("in_buffer")
    )


_FIRST_EVENT = f"""e(no, s, f) AS (VALUES {EVENT_VALUES}), hit AS (SELECT t.date, arg_min(no, no) AS no FROM t JOIN e ON t.date BETWEEN s - 14 AND f + 21 GROUP BY 1),
 h AS (SELECT t.date, e.s, e.f FROM t LEFT JOIN hit USING (date) LEFT JOIN e ON e.no = hit.no)"""


@query(
    "event_week_label",
    cte("v_daily") + f""", t AS (SELECT DISTINCT date FROM v_daily), {_FIRST_EVENT}
    SELECT CAST(date AS VARCHAR) AS date, CAST(CASE WHEN month(date) IN (6, 7, 8, 9, 10) THEN -1 WHEN s IS NULL THEN 0 WHEN date < s OR date > f THEN -1 WHEN (date - s) / 7.0 < 4 THEN 1 WHEN (date - s) / 7.0 < 10 THEN 2 ELSE 3 END AS INT) AS label FROM h""",
)
def event_week_label(spark, d):
    days = view(spark, d, "v_daily").select("date").distinct()
    return days.select(day(), sn.event_week_label(F.col("date"), EVENTS).alias("label"))


@query(
    "chl_label",
    cte("v_daily") + f""", t AS (SELECT DISTINCT date FROM v_daily), {_FIRST_EVENT}, c AS (SELECT date, cell_id, CASE WHEN cell_id % 7 = 0 THEN NULL ELSE sst / 5 END AS chl FROM v_daily)
    SELECT CAST(c.date AS VARCHAR) AS date, cell_id, CAST(CASE WHEN month(c.date) IN (6, 7, 8, 9, 10) THEN -1 WHEN s IS NULL THEN 0 WHEN c.date < s OR c.date > f THEN -1 WHEN chl IS NULL THEN -1 WHEN chl < 2.0 THEN 3 WHEN chl < 2.7 THEN 2 WHEN chl < 3.8 THEN 1 ELSE 0 END AS INT) AS label FROM c JOIN h USING (date)""",
)
def chl_label(spark, d):
    chl = F.when(F.col("cell_id") % 7 != 0, F.col("sst") / 5)
    return view(spark, d, "v_daily").select(day(), "cell_id", sn.chl_label(F.col("date"), chl, EVENTS).alias("label"))


_ADI = f""", g AS (SELECT date, {_WEIGHT} AS weight FROM (SELECT date, coalesce(avg(sst), 12) AS m FROM v_dense GROUP BY 1)),
 q AS (SELECT v.date, cell_id, CASE WHEN month(v.date) >= 11 THEN year(v.date) ELSE year(v.date) - 1 END AS season, (din IS NULL OR din <= 70) AS deficit, CAST(weight AS DOUBLE) AS weight FROM v_dense v JOIN g USING (date) WHERE month(v.date) NOT IN (6, 7, 8, 9, 10)),
 o AS (SELECT *, row_number() OVER (PARTITION BY cell_id, season ORDER BY date) AS k FROM q),
 walk AS (SELECT cell_id, season, date, k, CASE WHEN deficit THEN least(10.0, weight) ELSE 0.0 END::DOUBLE AS adi FROM o WHERE k = 1
   UNION ALL SELECT o.cell_id, o.season, o.date, o.k, CASE WHEN o.deficit THEN least(10.0, w.adi + o.weight) ELSE w.adi * 0.2 END::DOUBLE FROM walk w JOIN o ON o.cell_id = w.cell_id AND o.season = w.season AND o.k = w.k + 1)"""


@query("adi_index", cte_recursive("v_dense") + _ADI + " SELECT CAST(date AS VARCHAR) AS date, cell_id, CAST(season AS INT) AS season, round(adi, 6) AS adi FROM walk")
def adi_index(spark, d):
    return lb.adi_index(_cells(spark, d), ["cell_id"]).select(day(), "cell_id", "season", r6("adi"))


@query("replay_adi", cte_recursive("v_dense") + _ADI + " SELECT CAST(date AS VARCHAR) AS date, cell_id, CAST(season AS INT) AS season, round(adi, 6) AS adi FROM walk")
def replay_adi(spark, d):
    """The same index from an ordered replay of each cell."""
    return lb.replay_adi(_cells(spark, d), ["cell_id"]).select(day(), "cell_id", "season", r6("adi"))


_LABELS = _ADI + f""", e(no, s, f) AS (VALUES {EVENT_VALUES}), ev AS (SELECT DISTINCT t.date FROM (SELECT DISTINCT date FROM v_dense) t JOIN e ON t.date BETWEEN s - 14 AND f + 14),
 lab AS (SELECT v.date, v.cell_id, v.row_idx, v.col_idx, CAST(CASE WHEN month(v.date) IN (6, 7, 8, 9, 10) THEN -1 WHEN ev.date IS NULL THEN 0 WHEN adi >= 8 THEN 3 WHEN adi >= 5 THEN 2 WHEN adi >= 1 THEN 1 ELSE 0 END AS INT) AS label
  FROM v_dense v LEFT JOIN walk USING (date, cell_id) LEFT JOIN ev ON ev.date = v.date)"""


def adi_labelled(spark, d):
    return lb.adi_labels(_cells(spark, d), ["cell_id"], EVENTS)


@query("adi_labels", cte_recursive("v_dense") + _LABELS + " SELECT CAST(date AS VARCHAR) AS date, cell_id, label FROM lab")
def adi_labels(spark, d):
    return adi_labelled(spark, d).select(day(), "cell_id", "label")


@query("label_distribution", cte_recursive("v_dense") + _LABELS + " SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM lab GROUP BY 1")
def label_distribution(spark, d):
    return cb.label_distribution(adi_labelled(spark, d)).select("label", "n", r6("pct"))


@query("year_label_rollup", cte_recursive("v_dense") + _LABELS + " SELECT CAST(year(date) AS INT) AS year, label, count(*) AS n, count(*) FILTER (WHERE label > 0) AS n_abnormal FROM lab GROUP BY ROLLUP (1, 2)")
def year_label_rollup(spark, d):
    return cb.year_label_rollup(adi_labelled(spark, d))


@query(
    "area_fraction",
    cte_recursive("v_dense") + _LABELS + """ SELECT CAST(date AS VARCHAR) AS date, count(*) FILTER (WHERE label >= 0) AS valid_cells, round(coalesce(count(*) FILTER (WHERE label >= 1) / nullif(count(*) FILTER (WHERE label >= 0), 0)::DOUBLE, 0), 6) AS frac_1,
    round(coalesce(count(*) FILTER (WHERE label >= 2) / nullif(count(*) FILTER (WHERE label >= 0), 0)::DOUBLE, 0), 6) AS frac_2, round(coalesce(count(*) FILTER (WHERE label >= 3) / nullif(count(*) FILTER (WHERE label >= 0), 0)::DOUBLE, 0), 6) AS frac_3 FROM lab GROUP BY 1""",
)
def area_fraction(spark, d):
    return cb.area_fraction(adi_labelled(spark, d)).select(day(), "valid_cells", r6("frac_1"), r6("frac_2"), r6("frac_3"))


_PROFILE = """, dm AS (SELECT date, avg(sst) AS sst FROM v_dense GROUP BY 1), dl AS (SELECT date, max(label) AS label FROM lab GROUP BY 1), j AS (SELECT label, sst FROM dm JOIN dl USING (date)),
 prof AS (SELECT label, count(sst) AS n, round(avg(sst), 4) AS mean, round(stddev_pop(sst), 4) AS std, round(quantile_cont(sst, 0.1), 4) AS p10, round(quantile_cont(sst, 0.25), 4) AS p25, round(quantile_cont(sst, 0.5), 4) AS p50, round(quantile_cont(sst, 0.75), 4) AS p75, round(quantile_cont(sst, 0.9), 4) AS p90 FROM j GROUP BY 1)"""


def _profile(spark, d):
    daily = _cells(spark, d).groupBy("date").agg(F.avg("sst").alias("sst"))
    labels = adi_labelled(spark, d).groupBy("date").agg(F.max("label").alias("label"))
    return cb.label_percentiles(daily.join(labels, "date"), "label", "sst")


@query("label_percentiles", cte_recursive("v_dense") + _LABELS + _PROFILE + " SELECT * FROM prof")
def label_percentiles(spark, d):
    return _profile(spark, d)


@query(
    "threshold_midpoints",
    cte_recursive("v_dense") + _LABELS + _PROFILE + " SELECT label, p50, round((p50 + lead(p50) OVER (ORDER BY label)) / 2, 6) AS midpoint_to_next, round((1 - p50 / (SELECT p50 FROM prof WHERE label = 0)) * 100, 6) + 0.0 AS drop_pct FROM prof",
)
def threshold_midpoints(spark, d):
    return cb.threshold_midpoints(_profile(spark, d)).select("label", "p50", r6("midpoint_to_next"), r6("drop_pct"))


@query(
    "month_quota_sample",
    cte("v_daily") + f""", e(no, s, f) AS (VALUES {EVENT_VALUES}), t AS (SELECT DISTINCT date FROM v_daily WHERE month(date) NOT IN (6, 7, 8, 9, 10)),
    safe AS (SELECT date, month(date) AS m, ((date - DATE '1970-01-01') * 2654435761) % 1000 AS r FROM t WHERE NOT EXISTS (SELECT 1 FROM e WHERE t.date BETWEEN s - 14 AND f + 21)),
    k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY r, date) AS k FROM safe), q AS (SELECT * FROM k WHERE k <= greatest(1, 60 // (SELECT count(DISTINCT m) FROM safe)))
    SELECT CAST(date AS VARCHAR) AS date, CAST(m AS INT) AS month FROM q ORDER BY r, date LIMIT 60""",
)
def month_quota_sample(spark, d):
    days = view(spark, d, "v_daily").select("date").distinct().filter(sn.in_season(F.col("date")))
    order = (F.unix_date("date").cast("bigint") * 2654435761) % 1000
    return lb.month_quota_sample(days, EVENTS, 60, order).select(day(), "month")


@query(
    "labeled_sample",
    cte("v_daily") + f""", e(no, s, f) AS (VALUES {EVENT_VALUES}), ed AS (SELECT no, s, f, CAST(unnest(generate_series(s, f, INTERVAL 5 DAYS)) AS DATE) AS date FROM e), er AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY date) AS k FROM ed),
    ab AS (SELECT date, CASE WHEN (date - s) / 7.0 < 4 THEN 1 WHEN (date - s) / 7.0 < 10 THEN 2 ELSE 3 END AS label FROM er WHERE k <= 30 AND month(date) NOT IN (6, 7, 8, 9, 10)),
    t AS (SELECT DISTINCT date FROM v_daily WHERE month(date) NOT IN (6, 7, 8, 9, 10)), safe AS (SELECT date, month(date) AS m, ((date - DATE '1970-01-01') * 2654435761) % 1000 AS r FROM t WHERE NOT EXISTS (SELECT 1 FROM e WHERE t.date BETWEEN s - 14 AND f + 21)),
    k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY r, date) AS k FROM safe), q AS (SELECT * FROM k WHERE k <= greatest(1, 120 // (SELECT count(DISTINCT m) FROM safe))), nm AS (SELECT date, 0 AS label FROM q ORDER BY r, date LIMIT 120)
    SELECT CAST(x.date AS VARCHAR) AS date, cell_id, CAST(label AS INT) AS label, round(sst, 6) AS sst FROM (SELECT * FROM ab UNION ALL SELECT * FROM nm) x JOIN v_daily USING (date)""",
)
def labeled_sample(spark, d):
    """Cell readings on sampled event dates and on quiet dates with an equal quota per month."""
    daily = view(spark, d, "v_daily")
    events = lb.event_dates(spark, EVENTS).select("date", "label")
    days = daily.select("date").distinct().filter(sn.in_season(F.col("date")))
    order = (F.unix_date("date").cast("bigint") * 2654435761) % 1000
    normal = lb.month_quota_sample(days, EVENTS, 120, order).select("date", F.lit(0).alias("label"))
    return events.unionByName(normal).join(daily, "date").select(day(), "cell_id", F.col("label").cast("int").alias("label"), r6("sst"))


@query(
    "ema_accumulate",
    cte_recursive("v_daily") + """, o AS (SELECT date, cell_id, sst, row_number() OVER (PARTITION BY cell_id ORDER BY date) AS k FROM v_daily), walk AS (SELECT cell_id, date, k, sst AS ema FROM o WHERE k = 1
    UNION ALL SELECT o.cell_id, o.date, o.k, CAST(0.3 AS DOUBLE) * o.sst + CAST(0.7 AS DOUBLE) * w.ema FROM walk w JOIN o ON o.cell_id = w.cell_id AND o.k = w.k + 1) SELECT CAST(date AS VARCHAR) AS date, cell_id, round(ema, 6) AS ema FROM walk""",
)
def ema_accumulate(spark, d):
    from ..operators.dataset import ema_accumulate as ema

    return ema(view(spark, d, "v_daily").select("date", "cell_id", "sst"), ["cell_id"], "sst").select(day(), "cell_id", r6("ema"))


@query(
    "union_sources",
    cte("v_station_obs") + """SELECT 'survey' AS source, station_id, count(*) AS n, round(avg(water_temp), 6) AS water_temp, CAST(NULL AS DOUBLE) AS din FROM v_station_obs WHERE l_linenumber % 2 = 0 GROUP BY 2
    UNION ALL SELECT 'network', station_id, count(*), round(avg(water_temp), 6), round(avg(din_ugl), 6) FROM v_station_obs WHERE l_linenumber % 2 = 1 GROUP BY 2""",
)
def union_sources(spark, d):
    obs = view(spark, d, "v_station_obs")
    survey = obs.filter("l_linenumber % 2 = 0").select(F.lit("survey").alias("source"), "station_id", "water_temp")
    network = obs.filter("l_linenumber % 2 = 1").select(F.lit("network").alias("source"), "station_id", "water_temp", F.col("din_ugl").alias("din"))
    both = survey.unionByName(network, allowMissingColumns=True)
    return both.groupBy("source", "station_id").agg(F.count("*").alias("n"), r6(F.avg("water_temp"), "water_temp"), r6(F.avg("din"), "din"))
