"""The paths for large keys and large sides give the same rows as the plain ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import cube, evaluation, governance, interpolation, quality, retrieval, spatial, tables, temporal
from tidewater.plans import frames, ordering
from tidewater.sources import landed as landed_items
from tidewater.sources import tables as landed
from tidewater.streaming import jobs


@pytest.fixture(scope="module")
def readings(spark):
    rnd = random.Random(7)
    rows = [(i, 0 if rnd.random() < 0.5 else rnd.randrange(1, 6), 1000 + i // 3, float(rnd.choice([5.0, 5.0, rnd.uniform(0, 300)]))) for i in range(1500)]
    return spark.createDataFrame(rows, "id BIGINT, sensor INT, t BIGINT, value DOUBLE").withColumn("field", F.lit("din")).cache()


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("hot_rows", [60, 200])
def test_hot_keys_are_split_without_changing_flags(readings, hot_rows):
    order = [("t", True), ("id", True)]
    plain = quality.flag_outliers(readings, ["sensor"], order, window=50)
    split = quality.flag_outliers(readings, ["sensor"], order, window=50, hot_rows=hot_rows)
    cols = ["id", "sensor", "anomaly_type", "severity", "flag_no"]
    assert plain.count() > 0 and same(plain.select(cols), split.select(cols))


def test_rolling_monitor_on_hot_keys(readings):
    run = lambda hot: evaluation.perf_rolling(readings, ["sensor"], [("id", True)], "value", "value", 40, hot).select(
        "id", "win_n", "latency_p50", "latency_p95", "score_min"
    )
    assert same(run(10**9), run(100))


def test_row_index_with_heavy_ties(readings):
    got = ordering.row_index(readings, [], [("value", True), ("id", True)], "pos", n_slices=16)
    want = readings.withColumn("want", F.row_number().over(Window.orderBy("value", "id"))).select("id", "want")
    assert got.join(want, "id").filter("pos <> want").count() == 0
    down = ordering.row_index(readings, ["sensor"], [("value", False), ("id", True)], "pos", n_slices=8)
    want = readings.withColumn("want", F.row_number().over(Window.partitionBy("sensor").orderBy(F.desc("value"), "id"))).select("id", "want")
    assert down.join(want, "id").filter("pos <> want").count() == 0


def test_exact_quantiles(readings):
    got = ordering.exact_quantiles(readings, ["sensor"], "value", {"a": 0.1, "b": 0.95}, n_slices=8)
    want = readings.groupBy("sensor").agg(F.percentile("value", 0.1).alias("wa"), F.percentile("value", 0.95).alias("wb"))
    rows = got.join(want, "sensor").collect()
    assert len(rows) == 6 and all(math.isclose(r["a"], r["wa"]) and math.isclose(r["b"], r["wb"]) for r in rows)


def _places(n, seed, spread=1.0):
    rnd = random.Random(seed)
    return [(i, 34 + rnd.random() * spread, 126 + rnd.random() * spread) for i in range(n)]


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_against_brute_force(spark, k):
    targets = _places(60, 1, 5.0) + [(900, -50.0, -170.0)]
    sources = _places(40, 2, 0.05) + [(100 + i, a, b) for i, a, b in _places(30, 3, 8.0)]
    t = spark.createDataFrame(targets, "tid INT, lat DOUBLE, lon DOUBLE")
    s = spark.createDataFrame(sources, "sid INT, lat DOUBLE, lon DOUBLE")
    got = {}
    for r in spatial.nearest_neighbors(t, s, ["tid"], "sid", k).collect():
        got.setdefault(r["tid"], set()).add(r["sid"])
    for tid, lat, lon in targets:
        best = sorted(((lat - a) * (lat - a) + (lon - b) * (lon - b), sid) for sid, a, b in sources)[:k]
        assert got[tid] == {sid for _, sid in best}


def test_interpolation_with_sparse_groups_against_brute_force(spark):
    rnd = random.Random(5)
    places = _places(60, 4, 2.0)
    rows = [(g, i, a, b, rnd.random()) for g in range(4) for i, a, b in places if g == 0 or (g == 1 and a > 35.5) or (g == 2 and i < 3)]
    points = spark.createDataFrame(rows, "g INT, loc_id INT, lat DOUBLE, lon DOUBLE, value DOUBLE")
    box, h, w = (34.0, 36.0, 126.0, 128.0), 4, 3
    got = {(r["g"], r["row_idx"], r["col_idx"]): r["value"] for r in interpolation.interpolate_grid(points, box, h, w, ("g",), 5).collect()}
    assert len(got) == 3 * h * w
    for (g, r, c), value in got.items():
        lat, lon = 34 + r * 2 / (h - 1), 126 + c * 2 / (w - 1)
        near = sorted((math.hypot(lat - a, lon - b), i, v) for gg, i, a, b, v in rows if gg == g)[:5]
        weights = [1 / max(d, 1e-6) ** 2 for d, _, _ in near]
        assert value == pytest.approx(sum(x * v for x, (_, _, v) in zip(weights, near)) / sum(weights))


def test_cosine_blocks(spark):
    rng = np.random.default_rng(1)
    docs, queries = rng.normal(size=(200, 8)), rng.normal(size=(7, 8))
    frame = lambda m, key: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{key} BIGINT, vector ARRAY<DOUBLE>")
    got = retrieval.cosine_topk(frame(queries, "query_id"), frame(docs, "doc_id"), 3, block_rows=30)
    found = {(r["query_id"], r["rank"]): r["doc_id"] for r in got.collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-(unit(queries) @ unit(docs).T), axis=1)[:, :3]
    assert found == {(q, k + 1): best[q][k] for q in range(7) for k in range(3)}


def test_request_rate_across_slices(readings):
    reqs = readings.select("id", "sensor", (F.col("t") * 1_000_000).alias("micros"))
    got = governance.request_rate(reqs, ["sensor"], "micros", window_seconds=20, slice_seconds=50)
    w = Window.partitionBy("sensor").orderBy("micros").rangeBetween(-20_000_000, 0)
    assert same(got.select("id", "in_window"), reqs.withColumn("in_window", F.count("*").over(w)).select("id", "in_window"))


def test_within_days_against_cross_join(spark):
    day = lambda n, name: spark.range(n).select(F.expr("date_add(DATE '2024-01-01', CAST(id * 3 AS INT))").alias(name))
    got = temporal.within_days(day(40, "a"), day(55, "b"), 7, "a", "b")
    want = day(40, "a").crossJoin(day(55, "b")).filter("abs(datediff(a, b)) <= 7")
    assert same(got.select("a", "b"), want.select("a", "b"))


def test_staging_uses_the_configured_folder(spark):
    assert frames.staging_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))


def test_rate_limiter_stream_equals_a_replay(spark):
    rnd = random.Random(3)
    rows = sorted((rnd.randrange(0, 400) * 1_000_000, rnd.randrange(3)) for _ in range(200))
    rows = [(i, user, micros, 4) for i, (micros, user) in enumerate(rows)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    source, path = frames.staging_path(spark, "in"), frames.staging_path(spark, "limit")
    df = spark.createDataFrame(rows, "event_id BIGINT, user BIGINT, micros BIGINT, limit INT")
    for part in ("micros < 200000000", "micros >= 200000000"):
        df.filter(part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.rate_limit(stream, ["user"], path, 60).awaitTermination()
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(f"{path}/out").collect()}
    log, want = {}, {}
    for i, user, micros, limit in rows:
        kept = [t for t in log.get(user, []) if t >= micros - 60_000_000]
        want[i] = len(kept) < limit
        log[user] = kept + [micros] * want[i]
    assert got == want




@pytest.mark.parametrize("tolerance", [0, 12])
def test_first_in_window_equals_the_range_join(spark, tolerance):
    rnd = random.Random(11)
    rows = [(rnd.randrange(5), rnd.randrange(400), rnd.randrange(2), rnd.random()) for _ in range(300)]
    points = spark.createDataFrame(rows, "loc INT, n INT, source_rank INT, value DOUBLE").withColumn(
        "date", F.expr("date_add(DATE '2024-01-01', n)")
    )
    dates = spark.range(0, 400, 7).select(F.expr("date_add(DATE '2024-01-01', CAST(id AS INT))").alias("date"))
    got = temporal.first_in_window(points, dates, ["loc"], tolerance)
    near = temporal.within_days(dates, points.withColumnRenamed("date", "_obs"), tolerance, "date", "_obs")
    want = near.groupBy("date", "loc").agg(F.min(F.struct("source_rank", "_obs", "value"))["value"].alias("value"))
    cols = ["date", "loc", "value"]
    assert got.count() > 0 and same(got.select(cols), want.select(cols))


def test_interpolation_over_days_equals_the_one_day_way(spark, monkeypatch):
    """Tiles and stretches of days with rows missing, sources that overlap, and a place that has moved."""
    monkeypatch.setattr(interpolation, "TILE", 3)
    monkeypatch.setattr(interpolation, "DAYS", 5)
    rnd = random.Random(8)
    places = _places(40, 9, 2.0) + [(3, 34.5, 126.5)]
    rows = [(c, i, a, b, rnd.randrange(25), rnd.randrange(2), rnd.random()) for c in "xy" for i, a, b in places for _ in range(3 if c == "x" else 1)]
    points = spark.createDataFrame(rows, "channel STRING, loc_id INT, lat DOUBLE, lon DOUBLE, n INT, source_rank INT, value DOUBLE").withColumn(
        "date", F.expr("date_add(DATE '2024-01-01', n)")
    ).filter("channel = 'x' or n between 8 and 11")
    box, h, w = (34.0, 36.0, 126.0, 128.0), 5, 4
    spans = temporal.first_in_window_spans(points, ["channel", "loc_id", "lat", "lon"], 2)
    first, last = points.agg(F.min("date"), F.max("date")).first()
    wide = interpolation.interpolate_spans(spans, first, last, interpolation.Grid(box, h, w), ["x", "y", "z"], k=3, counted=True).collect()
    assert len(wide) == ((last - first).days + 1) * h * w and all(r["z"] is None and r["n_z"] == 0 for r in wide)
    dates = spark.createDataFrame([(x,) for x in {r["date"] for r in wide}], "date DATE")
    daily = temporal.first_in_window(points, dates, ["channel", "loc_id", "lat", "lon"], 2)
    one_day = interpolation.interpolate_grid(daily, box, h, w, ("date", "channel"), 3).collect()
    want = {(r["date"], r["row_idx"], r["col_idx"], r["channel"]): (r["value"], r["n_points"]) for r in one_day}
    got = {(r["date"], r["row_idx"], r["col_idx"], c): (r[c], r[f"n_{c}"]) for r in wide for c in "xy" if r[c] is not None}
    assert got.keys() == want.keys() and all(got[x] == (pytest.approx(want[x][0]), want[x][1]) for x in want)


def test_cube_of_no_readings(spark):
    bare = spark.createDataFrame([], "loc_id INT, lat DOUBLE, lon DOUBLE, date DATE, source_rank INT, measure STRING, value DOUBLE")
    empty = cube.channel_cube(bare, interpolation.Grid((34.0, 36.0, 126.0, 128.0), 2, 2))
    assert cube.fill_cube(empty).count() == 0


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_among_crowded_sources(spark, monkeypatch, k):
    """Three thousand sources in one cell of 0.01 degrees and a few elsewhere: exact, and few candidates for each target."""
    written = {}
    plain = spatial.staged
    monkeypatch.setattr(spatial, "staged", lambda df, label: written.__setitem__(label, plain(df, label)) or written[label])
    rnd = random.Random(12)
    crowd = [(i, 34.001 + rnd.random() * 0.008, 126.001 + rnd.random() * 0.008) for i in range(3000)]
    sources = crowd + [(5000 + i, a, b) for i, a, b in _places(20, 3, 3.0)] + [(9000, 34.005, 126.005), (9001, 34.005, 126.005)]
    targets = [(i, a, b) for i, a, b in _places(25, 7, 0.02)] + [(100 + i, a, b) for i, a, b in _places(20, 8, 3.0)] + [(900, -50.0, -170.0), (901, 34.005, 126.005)]
    t = spark.createDataFrame(targets, "tid INT, lat DOUBLE, lon DOUBLE")
    s = spark.createDataFrame(sources, "sid INT, lat DOUBLE, lon DOUBLE")
    got = {}
    for r in spatial.nearest_neighbors(t, s, ["tid"], "sid", k).collect():
        got.setdefault(r["tid"], set()).add(r["sid"])
    for tid, lat, lon in targets:
        best = sorted(((lat - a) * (lat - a) + (lon - b) * (lon - b), sid) for sid, a, b in sources)[:k]
        assert got[tid] == {sid for _, sid in best}
    assert written["frontier"].groupBy("tid").agg(F.sum("_n").alias("n")).agg(F.max("n")).first()[0] < 20 * spatial.DENSE


def _matches(names, asked):
    """Exact, else the best-ranked known name that contains the asked one or is contained in it."""
    out = {}
    for a in asked:
        hits = [(0 if a == n else 1, r) for n, r in names if a and n and (n in a or a in n)]
        out[a] = min(hits)[1] if hits else None
    return out


def test_fuzzy_names_against_all_pairs(spark):
    rnd = random.Random(9)
    word = lambda n: "".join(rnd.choice("abcé 島") for _ in range(n))
    names = [(word(rnd.randrange(0, 9)), i) for i in range(150)] + [("x" * 10_000 + "needle" + "y" * 10, 900), ("zzzz", 901), (None, 902)]
    asked = [word(rnd.randrange(0, 12)) for _ in range(150)] + ["a needley one", "needle", "q", "xxxx", "w" * 10_000 + "zzzz", "", None, "zzz"]
    known = spark.createDataFrame(names, "known_name STRING, rank INT").withColumn("found", F.col("rank"))
    df = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "id INT, name STRING")
    got = {r["id"]: r["found"] for r in tables.fuzzy_name_join(df, known, "name").collect()}
    want = _matches([(n, r) for n, r in names if n], {a for a in asked if a})
    assert len(got) == len(asked) and got == {i: want.get(a) for i, a in enumerate(asked)}


def test_merge_writes_only_partitions_that_are_hit(spark):
    import os

    path = frames.staging_path(spark, "merged")
    old = spark.createDataFrame([(m, i, float(m)) for m in (1, 2, 3) for i in range(4)], "month INT, id INT, v DOUBLE")
    old.write.partitionBy("month").parquet(path)
    local = path.removeprefix("file:")
    files = lambda m: sorted(f for f in os.listdir(f"{local}/month={m}") if f.endswith(".parquet")) if os.path.isdir(f"{local}/month={m}") else []
    before = {m: files(m) for m in (1, 2, 3)}
    rows = [(2, 1, 5, 50.0), (2, 1, 7, 70.0), (2, 1, 6, 60.0), (2, 9, 1, 90.0), (4, 0, 1, 40.0)]
    incoming = spark.createDataFrame(rows, "month INT, id INT, seq INT, v DOUBLE")
    for _ in range(2):  # also when it is repeated
        landed.upsert_partitions(spark, path, incoming, ["month", "id"], ["seq"], "month")
        assert files(1) == before[1] and files(3) == before[3] and files(2) != before[2] and files(4)
        got = {(r["month"], r["id"]): r["v"] for r in spark.read.parquet(path).collect()}
        want = {(m, i): float(m) for m in (1, 2, 3) for i in range(4)} | {(2, 1): 70.0, (2, 9): 90.0, (4, 0): 40.0}
        assert got == want
    fresh = frames.staging_path(spark, "fresh")
    landed.upsert_partitions(spark, fresh, incoming.drop("seq").withColumn("seq", F.lit(1)).filter("id <> 1"), ["month", "id"], ["seq"], "month")
    assert spark.read.parquet(fresh).count() == 2


def test_upsert_takes_the_last_arrival(spark):
    old = spark.createDataFrame([(1, 1.0)], "id INT, v DOUBLE")
    new = spark.createDataFrame([(1, 5.0, 1), (1, 3.0, 2), (2, 9.0, 1)], "id INT, v DOUBLE, seq INT")
    got = {r["id"]: r["v"] for r in tables.upsert(old, new, ["id"], ["seq"]).collect()}
    assert got == {1: 3.0, 2: 9.0}


def test_text_keys_with_one_prefix_fall_into_several_slices(spark):
    """A million keys that share their first bytes: many slices, none much larger than the others, ranks as sorted."""
    df = spark.range(1_000_000).select(F.format_string("sensor-station-%07d", F.col("id")).alias("k"), F.col("id"))
    sliced = ordering.with_slices(df, [("k", True)], 8).groupBy("_s1", "_s2").count().collect()
    assert len(sliced) == 8 and max(r["count"] for r in sliced) < 200_000
    assert ordering.row_index(df, [], [("k", True)], "at").filter("at <> id + 1").isEmpty()


def test_grid_lines_of_any_extent(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 9, 2.0), (1, 40, 3, 3.0), (2, 0, 1, None)], "month INT, r INT, c INT, v DOUBLE")
    lines = landed_items.climatology_lines(cells, ["month"], "r", "c", "v")
    assert {r["r"]: len(r["line"]) for r in lines.filter("month = 1").collect()} == {0: 10, 40: 10}
    points = landed_items.line_points(lines, ["month"], "r", "line", (0.0, 50.0, 0.0, 50.0), (0.0, 0.0), 1.0).collect()
    assert sorted(tuple(p) for p in points) == [(1, 0.0, 0.0, 1.0), (1, 0.0, 9.0, 2.0), (1, 40.0, 3.0, 3.0)]
