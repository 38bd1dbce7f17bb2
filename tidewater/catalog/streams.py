"""Streaming jobs fed by the given tables in time order; each must equal its batch counterpart."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..functions import risk
from ..operators.temporal import day_weight, first_per_key
from ..plans.frames import staged, staging_path
from ..streaming import jobs
from ..streaming.carry import output_of
from .base import cte, cte_recursive, day, dense_daily, query, r6, table, view
from .quality import _ALL, _R, _WIN, field_readings
from .seasons import _ADI, _FF, _W
from .tables import _ENDPOINT, requests

SLICES, FILES = 3, 4


def feed(df, order, label, slices=SLICES, files=FILES):
    """``df`` as a stream of time slices, one per batch: stretches of equal length between the first and the last day."""
    source = staged(df, f"source-{label}")  # read for the range of days and once per slice
    number = F.unix_date(F.col(order).cast("date"))
    low, high = source.agg(F.min(number), F.max(number)).first()
    return feed_slices(source, F.floor((number - low) * slices / (high - low + 1)), label, slices, files)


def feed_slices(source, piece, label, slices, files=FILES):
    """The rows of a written table as a stream whose batch number is ``piece``.

    Every slice becomes the same number of files, written by as many tasks one slice after the other, and a batch takes that many.
    Rows are dealt round, so no file is left out where a partition holds as many rows of the slice.
    """
    spark = source.sparkSession
    path = staging_path(spark, f"feed-{label}")
    for i in range(slices):
        share = F.pmod(F.monotonically_increasing_id(), F.lit(files)).cast("int")
        source.filter(piece == i).repartitionById(files, share).write.mode("append").parquet(path)
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files).parquet(path)


def finished(spark, job, path):
    job.awaitTermination()
    return output_of(spark, path)


@contextmanager
def state_store(spark):
    """The store that per-key processors need, for the queries started inside."""
    before = spark.conf.get(jobs.STORE_SETTING)
    spark.conf.set(jobs.STORE_SETTING, jobs.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(jobs.STORE_SETTING, before)


def last_updates(df, keys):
    """The final row per key of an update-mode result."""
    return first_per_key(df.withColumn("_b", -F.col("batch")), keys, ["_b"]).drop("_b")


@query("stream_dedup", "SELECT event_id, user_id, value FROM events")
def stream_dedup(spark, d):
    """Every reading is polled twice; each must land once."""
    events = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    path = staging_path(spark, "dedup")
    stream = feed(events.unionByName(events), "ts", "dedup")
    return finished(spark, jobs.dedup(stream, ["user_id"], "ts", path), path).select("event_id", "user_id", "value")


@query("stream_outliers", cte("v_readings") + _R + _WIN + _ALL + " SELECT event_id, sensor_id, field, value, anomaly_type, severity, threshold FROM flags")
def stream_outliers(spark, d):
    path = staging_path(spark, "outliers")
    stream = feed(field_readings(spark, d), "observed_at", "outliers")
    with state_store(spark):
        out = finished(spark, jobs.outliers(stream, ["sensor_id"], ["observed_at", "event_id"], path), path)
    return out.select("event_id", "sensor_id", "field", "value", "anomaly_type", "severity", "threshold")


@query("stream_adi", cte_recursive("v_dense") + _ADI + " SELECT CAST(date AS VARCHAR) AS date, cell_id, CAST(season AS INT) AS season, round(adi, 6) AS adi FROM walk")
def stream_adi(spark, d):
    path = staging_path(spark, "adi")
    daily = dense_daily(spark, d)
    stream = feed(daily.join(day_weight(daily), "date").select("date", "cell_id", "din", "weight"), "date", "adi")
    with state_store(spark):
        out = finished(spark, jobs.deficit_index(stream, ["cell_id"], path), path)
    return out.select(day(), "cell_id", "season", r6("adi"))


@query(
    "stream_perf",
    cte("v_scores") + """, w AS (SELECT pred_id, count(*) OVER v AS win_n, avg(latency_ms) OVER v AS lm, avg(warn) OVER v AS sm, list(latency_ms) OVER v AS l, list(stage) OVER v AS st FROM v_scores WINDOW v AS (PARTITION BY farm_id % 7 ORDER BY date, pred_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))
    SELECT pred_id, win_n, round(lm, 6) AS latency_mean, round(sm, 6) AS score_mean, list_sort(l)[CAST(least(win_n * 95 // 100, win_n - 1) + 1 AS INT)] AS latency_p95,
      CASE WHEN win_n >= 30 THEN round(abs(list_sum(list_transform([0, 1, 2, 3, 4], lambda s: CASE WHEN round(len(list_filter(st, lambda x: x = s))::DOUBLE / win_n, 4) > 0 THEN round(len(list_filter(st, lambda x: x = s))::DOUBLE / win_n, 4) * (round(len(list_filter(st, lambda x: x = s))::DOUBLE / win_n, 4) / (0.2 + 1e-8) + 1e-8) ELSE 0 END)) - 1), 6) END AS chi2_drift FROM w""",
)
def stream_perf(spark, d):
    path = staging_path(spark, "perf")
    scores = view(spark, d, "v_scores").withColumn("model", F.col("farm_id") % 7)
    stream = feed(scores, "date", "perf")
    with state_store(spark):
        out = finished(spark, jobs.monitor(stream, ["model"], ["date", "pred_id"], "latency_ms", "warn", path, stage="stage", baseline=[0.2] * 5), path)
    return out.select("pred_id", "win_n", r6("latency_mean"), r6("score_mean"), "latency_p95", r6("chi2_drift"))


@query(
    "stream_latest",
    cte("v_readings") + "SELECT sensor_id, event_id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY observed_at DESC, event_id DESC) AS rn FROM v_readings) WHERE rn = 1",
)
def stream_latest(spark, d):
    path = staging_path(spark, "latest")
    job = jobs.latest(feed(view(spark, d, "v_readings"), "observed_at", "latest"), ["sensor_id"], ["observed_at", "event_id"], path)
    return last_updates(finished(spark, job, path), ["sensor_id"]).select("sensor_id", "event_id", "field", "value")


@query(
    "stream_rate_limit",
    f"""WITH RECURSIVE e AS (SELECT event_id, user_id, endpoint, t, row_number() OVER (PARTITION BY user_id, endpoint ORDER BY t, event_id) AS n
      FROM (SELECT event_id, user_id, {_ENDPOINT} AS endpoint, epoch_us(ts) AS t FROM events)),
    s AS (
      SELECT user_id, endpoint, n, event_id, TRUE AS allowed, [t] AS log, 0 AS n_past, (t + 43200000000) // 1000000 AS reset_at, t // 1000000 AS now FROM e WHERE n = 1
      UNION ALL
      SELECT user_id, endpoint, n, event_id, len(past) < 2, CASE WHEN len(past) < 2 THEN list_append(past, t) ELSE past END, len(past),
        (coalesce(past[1], t) + 43200000000) // 1000000, t // 1000000
      FROM (SELECT e.user_id, e.endpoint, e.n, e.event_id, e.t, list_filter(s.log, lambda x: x >= e.t - 43200000000) AS past
            FROM s JOIN e ON e.user_id = s.user_id AND e.endpoint = s.endpoint AND e.n = s.n + 1)
    )
    SELECT event_id, allowed, CAST(greatest(1 - n_past, 0) AS BIGINT) AS remaining, reset_at, CASE WHEN NOT allowed THEN greatest(0, reset_at - now) END AS retry_after FROM s""",
)
def stream_rate_limit(spark, d):
    """At most two admitted requests per user and endpoint in twelve hours."""
    path = staging_path(spark, "rate")
    r = requests(spark, d).select("event_id", "user_id", "endpoint", F.col("ts").cast("timestamp").alias("ts"), "micros", F.lit(2).alias("limit"))
    with state_store(spark):
        job = jobs.rate_limit(feed(r, "ts", "rate"), ["user_id", "endpoint"], path, 43_200, "ts", "2 days")
        return finished(spark, job, path).select("event_id", "allowed", "remaining", "reset_at", "retry_after")


@query(
    "stream_norm_stats",
    "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max FROM events GROUP BY 1",
)
def stream_norm_stats(spark, d):
    path = staging_path(spark, "stats")
    stream = feed(table(spark, d, "events").select("ts", "event_type", "value"), "ts", "stats")
    out = finished(spark, jobs.running_statistics(stream, "event_type", "value", path), path)
    return last_updates(out, ["event_type"]).select("event_type", "n", r6("mean"), r6("std"), "min", "max")


@query("stream_daily_composite", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, user_id, round(quantile_cont(value, 0.5), 6) AS value FROM events GROUP BY 1, 2")
def stream_daily_composite(spark, d):
    path = staging_path(spark, "composite")
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    out = finished(spark, jobs.daily_composite(feed(events, "ts", "composite"), "ts", ["user_id"], "value", path), path)
    return last_updates(out, ["date", "user_id"]).select(day(), "user_id", r6("value"))


@query(
    "stream_rain24",
    """WITH w AS (SELECT event_type, value, unnest(generate_series(date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('hour', ts) + INTERVAL 24 HOURS, INTERVAL 1 HOUR)) AS e FROM events)
    SELECT strftime(e, '%Y-%m-%d %H') AS window_end, event_type, round(sum(value), 6) AS total FROM w GROUP BY 1, 2""",
)
def stream_rain24(spark, d):
    path = staging_path(spark, "rain")
    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = finished(spark, jobs.rain_24h(feed(events, "ts", "rain"), "ts", ["event_type"], "value", path), path)
    return last_updates(out, ["window_end", "event_type"]).select(
        F.date_format("window_end", "yyyy-MM-dd HH").alias("window_end"), "event_type", r6("total")
    )


@query(
    "stream_ffill",
    cte("v_dense") + f""", n AS (SELECT *, row_number() OVER ({_W}) AS p, {_FF} AS ff FROM v_dense) SELECT CAST(date AS VARCHAR) AS date, cell_id, round(ff, 6) AS value,
    p - last_value(CASE WHEN coalesce(din, 0) / 100 > 0.5 OR p = 1 THEN p END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dry FROM n""",
)
def stream_ffill(spark, d):
    path = staging_path(spark, "fill")
    daily = dense_daily(spark, d).select("date", "cell_id", "din", (F.coalesce("din", F.lit(0.0)) / 100).alias("rain"))
    stream = feed(daily, "date", "fill")
    with state_store(spark):
        out = finished(spark, jobs.fill_and_count(stream, ["cell_id"], "din", "rain", path), path)
    return out.select(day(), "cell_id", r6("value"), "dry")


@query(
    "stream_alerts",
    cte("v_scores") + """, n AS (SELECT * FROM (SELECT s.*, e.ts, row_number() OVER (ORDER BY e.ts DESC, pred_id DESC) AS rn FROM v_scores s JOIN events e ON e.event_id = s.pred_id) WHERE rn <= 60),
    a AS (SELECT *, row_number() OVER (ORDER BY ts DESC, pred_id DESC) - 1 AS alert_no FROM n WHERE warn >= 0.3) SELECT pred_id, alert_no, CASE WHEN warn >= .8 THEN 'DANGER' WHEN warn >= .6 THEN 'WARNING' ELSE 'CAUTION' END AS severity FROM a WHERE alert_no < 20""",
)
def stream_alerts(spark, d):
    path = staging_path(spark, "alerts")
    warn = F.col("value") / (F.col("value") + 30.0)
    events = table(spark, d, "events").select(F.col("event_id").alias("pred_id"), "ts", risk.severity_band(warn).alias("severity"))
    stream = feed(events, "ts", "alerts")
    with state_store(spark):
        out = finished(spark, jobs.alerts(stream, "ts", "pred_id", "severity", path), path)
    newest = out.select(F.max("batch")).scalar()
    return out.filter(F.col("batch") == newest).select("pred_id", F.col("alert_no").cast("bigint").alias("alert_no"), "severity")


@query(
    "stream_late_rows",
    """WITH b AS (SELECT min(CAST(ts AS DATE)) AS low, max(CAST(ts AS DATE)) AS high FROM events),
    e AS (SELECT event_id, ts, CASE WHEN event_id % 40 = 0 THEN 5 ELSE (CAST(ts AS DATE) - low) * 6 // (high - low + 1) END AS batch FROM events, b),
    m AS (SELECT batch, count(*) AS n_rows, max(ts) AS newest FROM e GROUP BY 1),
    w AS (SELECT batch, n_rows, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 2 DAYS AS mark FROM m)
    SELECT CAST(w.batch AS BIGINT) AS batch, w.n_rows, count(*) FILTER (WHERE date_trunc('millisecond', e.ts) <= date_trunc('millisecond', w.mark)) AS n_late FROM w JOIN e ON e.batch = w.batch GROUP BY 1, 2""",
)
def stream_late_rows(spark, d):
    """One reading in forty arrives with the last of six slices; those behind the watermark of two days are dropped and counted.

    The watermark that judges a batch is that of the batch before it, so it stands on the slices up to two before.
    """
    path = staging_path(spark, "late")
    source = staged(table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")), "source-late")
    number = F.unix_date(F.col("ts").cast("date"))
    low, high = source.agg(F.min(number), F.max(number)).first()
    piece = F.when(F.col("event_id") % 40 == 0, 5).otherwise(F.floor((number - low) * 6 / (high - low + 1)))
    job = jobs.late_rows(feed_slices(source, piece, "late", 6), "ts", ["event_id"], path, "2 days")
    job.awaitTermination()
    return jobs.late_counts(spark, job)
