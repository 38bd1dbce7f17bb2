"""Stretches of days with many readings are thinned part by part, and the cube stays the same."""

import datetime
import random

from tidewater.operators import interpolation as ip


def test_parts_change_nothing(spark, monkeypatch):
    rnd = random.Random(3)
    day = lambda i: datetime.date(2023, 1, 1) + datetime.timedelta(days=i)
    rows = []
    for i in range(1500):
        place, first = rnd.randrange(120), rnd.randrange(90)
        # Places come in threes at one distance, so that ties count too
        rows.append((rnd.choice("ab"), rnd.randrange(2), place, 34.0 + place // 3 * 0.05, 126.0 + place // 3 * 7 % 40 * 0.05, rnd.random(), day(first), day(first + rnd.randrange(5))))
    spans = spark.createDataFrame(rows, "channel STRING, source_rank INT, loc_id BIGINT, lat DOUBLE, lon DOUBLE, value DOUBLE, first_day DATE, last_day DATE").localCheckpoint()
    made = lambda: ip.interpolate_spans(spans, day(0), day(95), ip.Grid((34.0, 36.0, 126.0, 128.0), 4, 5), ["a", "b"], 4, counted=True).collect()
    whole = sorted(map(str, made()))
    calls = []
    plain = ip._near_any
    monkeypatch.setattr(ip, "_near_any", lambda *a: calls.append(a) or plain(*a))
    for rows_of_part in (400, 37):
        monkeypatch.setattr(ip, "ROWS", rows_of_part)
        assert sorted(map(str, made())) == whole
    assert len(calls) == 2 and len(whole) == 96 * 20
