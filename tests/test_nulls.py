"""NULL keys, windows longer than a slice, text sort keys, empty batches, and the staging folder."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators import dataset, evaluation, governance, quality, retrieval, tables
from tidewater.plans import frames, ordering
from tidewater.streaming import jobs


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_null_keys_stay(spark):
    df = spark.createDataFrame(
        [(None, 1, 3.0), (None, 2, 5.0), ("a", 3, 1.0), ("a", 4, 2.0), ("b", 5, 9.0)], "name STRING, id BIGINT, v DOUBLE")
    assert rows(tables.group_members(df, "name", "id")) == rows(spark.createDataFrame(
        [(None, 1, 2), (None, 2, 2), ("a", 3, 2), ("a", 4, 2), ("b", 5, 1)], "a STRING, b BIGINT, c BIGINT"))
    assert tables.duplicate_labels(df, "name", "id").count() == 5
    farms = df.withColumns({"lat": F.col("v"), "lon": F.col("v")})
    assert {r.id: r.zone for r in tables.zone_codes(farms, "name", "id").collect()} == {1: "A-02", 2: "A-01", 3: "A-02", 4: "A-01", 5: "A-01"}
    stats = {r.name: (r.mean_ms, r.n) for r in evaluation.latency_stats(df, "v", ["name"]).collect()}
    assert stats == {None: (4.0, 2), "a": (1.5, 2), "b": (9.0, 1)}
    medians = {r.name: r.m for r in ordering.exact_quantiles(df, ["name"], "v", {"m": 0.5}).collect()}
    assert medians == {None: 4.0, "a": 1.5, "b": 9.0}
    starts = df.select(F.col("name").alias("label"), F.col("id").alias("t"))
    assert dataset.stratified_split(starts).count() == 5


def test_order_by_text_and_boolean(spark):
    names = ["", "a", "aa", "ab", "abcdef1", "abcdef2", "abcdefg", "b", "é", None] * 3
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name STRING, id BIGINT")
    placed = ordering.row_index(df, [], [("name", True), ("id", True)], n_slices=6).collect()
    want = sorted(range(len(names)), key=lambda i: (names[i] is not None, (names[i] or "").encode(), i))
    assert [r.id for r in sorted(placed, key=lambda r: r.row_index)] == want
    flags = df.withColumn("f", F.col("id") % 2 == 0)
    assert ordering.row_index(flags, [], [("f", True), ("id", True)], n_slices=4).filter("row_index <= 15 and f").count() == 0


def test_hot_keys_of_any_type(spark):
    df = spark.createDataFrame(
        [(k, f"{i:04d}", float((i * 37) % 11)) for k in ("x", None) for i in range(300)] + [("y", "0001", 1.0)], "k STRING, at STRING, value DOUBLE")
    order = [("at", True)]
    whole = quality.window_statistics(df, ["k"], order, window=10)
    cut = quality.window_statistics(df, ["k"], order, window=10, hot_rows=50)
    pick = lambda d: rows(d.select("k", "at", "value", "win_n", F.round("win_mean", 9), "prev_value"))
    assert pick(whole) == pick(cut) and cut.count() == 601


def test_request_window_longer_than_a_slice(spark):
    second = 1_000_000
    times = [0, 10, 3_600, 7_000, 10_900, 14_400, 14_401, 30_000]
    df = spark.createDataFrame([("u", t * second) for t in times] + [("u", None)], "user STRING, micros BIGINT")
    got = {r.micros: r.in_window for r in governance.request_rate(df, ["user"], "micros", window_seconds=14_400, slice_seconds=3_600).collect()}
    assert got == {t * second: sum(1 for x in times if t - 14_400 <= x <= t) for t in times}


def test_dedup_keeps_its_carry_over_an_empty_batch(spark, tmp_path, monkeypatch):
    held = {}
    monkeypatch.setattr(jobs, "start_with_carry", lambda stream, step, path: held.update(step=step))
    schema = "k BIGINT, ts TIMESTAMP"
    jobs.dedup(spark.readStream.schema(schema).parquet(str(tmp_path)), ["k"], "ts", "unused")
    seen = spark.sql("SELECT 1L AS k, TIMESTAMP '2024-01-01' AS ts")
    none = spark.createDataFrame([], schema)
    assert [tuple(r) for r in held["step"](none, seen)[1].select("k").collect()] == [(1,)]
    assert held["step"](seen, seen)[0].count() == 0
    assert held["step"](none, None)[1].count() == 0


def test_zero_vectors_and_ties(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0])], "doc_id BIGINT, vector ARRAY<DOUBLE>")
    asked = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0])], "query_id BIGINT, vector ARRAY<DOUBLE>")
    for block in (1, 2, 4_000):
        got = retrieval.cosine_topk(asked, docs, k=2, block_rows=block, block_queries=1).select("query_id", "doc_id", "rank")
        assert rows(got) == [(1, 1, 1), (1, 2, 2)]


def test_a_cluster_must_name_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        frames.staging_dir(Session())


def test_calendar_has_the_dates_that_occur(spark):
    df = spark.sql("SELECT * FROM VALUES (1, DATE '2024-01-01'), (2, DATE '2024-01-02'), (1, DATE '1900-01-01') AS t(e, date)")
    assert frames.calendar(df, ["e"]).count() == 6
