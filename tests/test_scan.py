"""Accumulations against a plain fold: long histories, gaps, null keys, several levels of stretches."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions import fixed_values as fx
from tidewater.operators import dataset, labels
from tidewater.plans import scan


def fold(rows, start=0.0):
    """rows: (key, position, a, b, c)"""
    state, out = {}, {}
    for key, at, a, b, c in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        state[key] = min(c, a * state.get(key, start) + b)
        out[key, at] = state[key]
    return out


@pytest.mark.parametrize("stretch, start", [(64, 0.0), (4, 0.0), (3, 2.5)])
def test_scan_equals_the_fold(spark, monkeypatch, stretch, start):
    monkeypatch.setattr(scan, "STRETCH", stretch)
    rnd = random.Random(stretch)
    rows = []
    for key, n in (("long", 700), ("short", 3), (None, 90)):
        for at in rnd.sample(range(-50, 1500), n):
            a = rnd.choice([1.0, 0.2, 0.0, 0.9])
            rows.append((key, at, a, rnd.random() * 3, rnd.choice([4.0, 10.0, float("inf")])))
    df = spark.createDataFrame(rows, "key STRING, at INT, a DOUBLE, b DOUBLE, c DOUBLE")
    got = scan.accumulate(df, ["key"], "at", scan.affine(F.col("a"), F.col("b"), F.col("c")), "state", F.lit(start)).collect()
    want = fold(rows, start)
    assert len(got) == len(rows) and all(r["state"] == pytest.approx(want[r["key"], r["at"]]) for r in got)
    assert {tuple(r)[:5] for r in got} == set(rows)


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([], "key STRING, at INT")
    assert scan.accumulate(df, ["key"], "at", scan.affine(1.0, 1.0), "state").count() == 0


def test_no_task_gathers_a_whole_key(spark, monkeypatch):
    """A key of 100,000 rows is written in packs of one stretch, and sums of ones count the rows."""
    written = {}
    plain = scan.staged
    monkeypatch.setattr(scan, "staged", lambda df, label: written.setdefault(label, plain(df, label)))
    df = spark.range(100_000).select(F.lit(1).alias("key"), F.col("id").alias("at"))
    assert scan.accumulate(df, ["key"], "at", scan.affine(1.0, 1.0), "state").filter("state <> at + 1").isEmpty()
    sizes = written["packs"].select(F.size("_s").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert tuple(sizes) == (scan.STRETCH, -(-100_000 // scan.STRETCH))


def test_deficit_index_of_a_long_season_and_a_carry(spark):
    rnd = random.Random(3)
    days = [(c, i, rnd.choice([None, 60.0, 90.0]), 12.0 + rnd.random() * 6) for c in (1, 2) for i in range(212)]
    dense = spark.createDataFrame(days, "cell INT, n INT, din DOUBLE, sst DOUBLE").withColumn("date", F.expr("date_add(DATE '2021-11-01', n)"))
    carry = spark.createDataFrame([(1, 2021, 3.25)], "cell INT, season INT, adi DOUBLE")
    mean = {r["n"]: r["m"] for r in dense.groupBy("n").agg(F.avg("sst").alias("m")).collect()}
    for before, first in ((None, 0.0), (carry, 3.25)):
        got = {(r["cell"], r["date"]): r["adi"] for r in labels.adi_index(dense, ["cell"], carry=before).collect()}
        for cell in (1, 2):
            adi = first if cell == 1 else 0.0
            for _, n, din, _ in sorted(d for d in days if d[0] == cell):
                date = dense.filter(f"cell = {cell} and n = {n}").first()["date"] if n in (0, 63, 64, 150, 211) else None
                weight = 1.5 if mean[n] >= 15 else 1.0
                adi = min(fx.ADI_CEILING, adi + weight) if din is None or din <= fx.DIN_DEFICIT_UGL else adi * fx.ADI_DECAY
                if (cell, date) in got:
                    assert got[cell, date] == pytest.approx(adi)
        assert len(got) == 2 * 212


def test_moving_accumulation_with_missing_values(spark):
    rows = [("a", n, v) for n, v in enumerate([None, 4.0, None, 8.0])] + [(None, 0, 1.0), (None, 9, 2.0)]
    df = spark.createDataFrame(rows, "k STRING, n INT, v DOUBLE").withColumn("date", F.expr("date_add(DATE '2024-01-01', n)"))
    got = {(r["k"], r["date"].day - 1): r["ema"] for r in dataset.ema_accumulate(df, ["k"], "v").collect()}
    want = {("a", 0): None, ("a", 1): 4.0, ("a", 2): 4.0, ("a", 3): 0.3 * 8 + 0.7 * 4, (None, 0): 1.0, (None, 9): 0.3 * 2 + 0.7}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) if want[x] is not None else got[x] is None for x in want)
