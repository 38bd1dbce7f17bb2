"""Stream operators with per-key state: restarts, rows out of order, late rows, expiry."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewater.operators import quality
from tidewater.plans.frames import staging_path
from tidewater.streaming import jobs
from tidewater.streaming.carry import output_of

START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set(jobs.STORE_SETTING, jobs.ROCKSDB)
    yield
    spark.conf.unset(jobs.STORE_SETTING)


def source_of(spark, parts, schema, label):
    """A folder with one file per part, and the function that lands the next one."""
    path = staging_path(spark, label)
    waiting = iter(parts)

    def land():
        spark.createDataFrame(next(waiting), schema).coalesce(1).write.mode("append").parquet(path)

    return path, land, lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_outliers_go_on_after_a_restart(spark):
    """The query is started anew for every part; windows reach back over the parts, rows of a part are in no order."""
    rnd = random.Random(2)
    rows = [(i, i % 3, START + timedelta(minutes=i), "water_temp", rnd.choice([15.0, 15.5, 16.0, 40.0 + i / 100, None])) for i in range(400)]
    schema = "event_id BIGINT, sensor INT, at TIMESTAMP, field STRING, value DOUBLE"
    parts = [rows[:90], rows[90:250], rows[250:]]
    for p in parts:
        rnd.shuffle(p)
    path, land, stream = source_of(spark, parts, schema, "restart")
    out = staging_path(spark, "restart-out")
    for _ in parts:
        land()
        jobs.outliers(stream(), ["sensor"], ["at", "event_id"], out, window=20).awaitTermination()
    want = quality.flag_outliers(spark.createDataFrame(rows, schema), ["sensor"], [("at", True), ("event_id", True)], window=20)
    flags = lambda df: sorted(tuple(r) for r in df.select("event_id", "anomaly_type", "severity", F.round("threshold", 6)).collect())
    got = output_of(spark, out)
    assert got.select("batch").distinct().count() == 3 and flags(got) == flags(want) and len(flags(want)) > 50


def test_fill_and_count_goes_on_after_a_restart(spark):
    rows = [(1, START.date() + timedelta(days=i), [None, 5.0, None, None, 7.0, None][i], [0.0, 0.0, 0.9, 0.1, 0.0, 0.0][i]) for i in range(6)]
    schema = "cell INT, date DATE, v DOUBLE, rain DOUBLE"
    path, land, stream = source_of(spark, [rows[:2], rows[2:4], rows[4:]], schema, "fill")
    out = staging_path(spark, "fill-out")
    for _ in range(3):
        land()
        jobs.fill_and_count(stream(), ["cell"], "v", "rain", out).awaitTermination()
    got = [(r["value"], r["dry"]) for r in output_of(spark, out).orderBy("date").collect()]
    assert got == [(None, 0), (5.0, 1), (5.0, 0), (5.0, 1), (7.0, 2), (7.0, 3)]


def test_alert_ring_takes_what_arrives_late(spark):
    rows = [(START + timedelta(minutes=i), i, "DANGER" if i % 2 else "NORMAL") for i in range(40)]
    path, land, stream = source_of(spark, [rows[20:], rows[:20] + [(START + timedelta(minutes=99), 99, "WARNING")]], "ts TIMESTAMP, id BIGINT, severity STRING", "ring")
    out = staging_path(spark, "ring-out")
    for _ in range(2):
        land()
        jobs.alerts(stream(), "ts", "id", "severity", out, recent=10, shown=3, shards=4).awaitTermination()
    got = output_of(spark, out)
    ids = lambda b: [r["id"] for r in got.filter(f"batch = {b}").orderBy("alert_no").collect()]
    assert ids(0) == [39, 37, 35] and ids(1) == [99, 39, 37]


def test_limiter_answers_and_expiry(spark):
    """Two requests in ten seconds; what a request is told, and a key that is quiet until its timer is due."""
    at = lambda s: START + timedelta(seconds=s)
    row = lambda i, user, s: (i, user, at(s), int(s * 1_000_000), 2)
    parts = [[row(1, "a", 0), row(2, "a", 4), row(3, "a", 5)], [row(4, "b", 600)], [row(5, "b", 1200)], [row(6, "a", 1201)]]
    path, land, stream = source_of(spark, parts, "event_id BIGINT, user STRING, ts TIMESTAMP, micros BIGINT, limit INT", "limit")
    # Timers count from the epoch, the rows' micros with them
    shifted = lambda df: df.withColumn("micros", F.unix_micros("ts"))
    out = staging_path(spark, "limit-out")
    for _ in parts:
        land()
        jobs.rate_limit(shifted(stream()), ["user"], out, 10, "ts", "1 second").awaitTermination()
    base = int(spark.range(1).select(F.unix_micros(F.lit(START).cast("timestamp"))).first()[0]) // 1_000_000
    got = {r["event_id"]: (r["allowed"], r["remaining"], r["reset_at"] - base, r["retry_after"]) for r in output_of(spark, out).collect()}
    assert got == {
        1: (True, 1, 10, None), 2: (True, 0, 10, None), 3: (False, 0, 10, 5), 4: (True, 1, 610, None), 5: (True, 1, 1210, None), 6: (True, 1, 1211, None),
    }


def test_late_rows_are_dropped_and_counted(spark):
    row = lambda i, s: (i, START + timedelta(seconds=s))
    parts = [[row(1, 100)], [row(2, 200)], [row(3, 300), row(4, 50), row(5, 95)], [row(6, 120), row(7, 195)]]
    path, land, stream = source_of(spark, parts, "event_id BIGINT, ts TIMESTAMP", "late")
    for _ in parts:
        land()
    out = staging_path(spark, "late-out")
    job = jobs.late_rows(stream(), "ts", ["event_id"], out, "10 seconds")
    job.awaitTermination()
    # Batch 2 is judged by the watermark after batch 0 (90 s), batch 3 by that after batch 1 (190 s)
    assert [tuple(r) for r in jobs.late_counts(spark, job).orderBy("batch").collect()] == [(0, 1, 0), (1, 1, 0), (2, 2 + 1, 1), (3, 2, 1)]
    assert sorted(r["event_id"] for r in output_of(spark, out).collect()) == [1, 2, 3, 5, 7]


def test_limiter_takes_plain_rows_and_leaves_an_unchanged_state():
    """Requests that are all refused change neither the log nor the timer of their key."""
    from pyspark.sql import Row

    from tidewater.streaming.processors import SlidingLog

    class Held:
        def __init__(self, times):
            self.held, self.puts = [(t,) for t in times], 0
        exists = lambda self: bool(self.held)
        get = lambda self: iter(self.held)

        def put(self, times):
            self.held, self.puts = times, self.puts + 1

    made = SlidingLog(10_000_000, True)
    made.handle, made.times = None, Held([1_000_000, 2_000_000])
    rows = [Row(event_id=8, micros=4_000_000, limit=2), Row(event_id=7, micros=3_000_000, limit=2)]
    assert [tuple(r) for r in made.handleInputRows(("a",), iter(rows), None)] == [(7, False, 0, 11, 8), (8, False, 0, 11, 7)]
    assert made.times.puts == 0
