"""Hand-checked cases of the domain rules."""

import pytest
from pyspark.sql import functions as F

from tidewater.functions import numeric as nm
from tidewater.functions import optics, risk, seasons
from tidewater.functions import text as tx
from tidewater.operators import cube, dataset, evaluation, governance, interpolation, labels, packs, spatial, tables, temporal


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def days(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("date", F.col("date").cast("date"))


def test_risk_index_molar(spark):
    score = risk.risk_index_molar(*[F.lit(x) for x in (2.5, 25.0, 5.0, 4.0, 30.0)])
    assert one(spark, score) == pytest.approx(0.38 * 0.5 + 0.27 * 0.5 + 0.19 * 0.5 + 0.1 * 0.2 + 0.06 * 0.5)
    assert one(spark, risk.risk_stage(score)) == 2


def test_risk_index_mass_treats_zero_as_missing(spark):
    none = F.lit(None).cast("double")
    assert one(spark, risk.risk_index_mass(F.lit(0.0), none, none, none, none)) == 0.0


@pytest.mark.parametrize(
    "date,label",
    [
        ("2023-07-15", -1), ("2023-10-01", -1), ("2023-10-20", -1), ("2022-12-01", 0), ("2023-11-05", 1), ("2023-12-10", 2),
        ("2024-01-20", 3), ("2022-01-01", 1), ("2022-02-28", 2), ("2022-03-10", -1), ("2022-03-22", 0),
    ],
)
def test_event_week_label(spark, date, label):
    assert one(spark, seasons.event_week_label(F.lit(date).cast("date"))) == label


@pytest.mark.parametrize("chl,label", [(1.9, 3), (2.0, 2), (2.7, 1), (3.8, 0), (None, -1)])
def test_chl_label(spark, chl, label):
    assert one(spark, seasons.chl_label(F.lit("2023-12-01").cast("date"), F.lit(chl).cast("double"))) == label


def test_optics(spark):
    assert one(spark, optics.oc3_chlorophyll(F.lit(0.004), F.lit(0.005), F.lit(0.004))) == pytest.approx(0.98504820, abs=1e-7)
    assert one(spark, optics.ndci(F.lit(400), F.lit(500), F.lit(6))) == pytest.approx(1 / 9)
    assert [one(spark, optics.clear_pixel(F.lit(f))) for f in (0, 16, 1, 512)] == [True, True, False, False]


def test_wind_text(spark):
    assert [one(spark, nm.wind_degrees(F.lit(w))) for w in ("NNE", "북", "135", "??")] == [22.5, 0.0, 135.0, None]


def test_sum_present(spark):
    pairs = [(None, 2.0), (1.0, None), (None, None)]
    got = [one(spark, nm.sum_present(F.lit(a).cast("double"), F.lit(b).cast("double"))) for a, b in pairs]
    assert got == [2.0, 1.0, None]


def test_zone_letters(spark):
    got = [one(spark, tx.zone_letters(F.lit(i))) for i in (0, 25, 26, 701, 702)]
    assert got == ["A", "Z", "AA", "ZZ", "AAA"]


def test_days_since_rain(spark):
    rain = days(spark, [(1, f"2024-01-0{i + 1}", float(r)) for i, r in enumerate([0, 0, 1, 0, 0])], "cell INT, date STRING, rain DOUBLE")
    got = temporal.days_since_rain(rain, ["cell"], "rain").orderBy("date").collect()
    assert [r["days_since_rain"] for r in got] == [0, 1, 0, 1, 2]


def test_trailing_deficit_covers_29_rows(spark):
    df = spark.range(40).select(
        F.lit(1).alias("cell"), F.expr("date_add(DATE '2024-01-01', CAST(id AS INT))").alias("date"), F.lit(69.0).alias("din"), F.lit(12.0).alias("sst")
    )
    got = temporal.deficit_features(df, ["cell"]).orderBy("date").collect()
    assert [r["deficit_30d"] for r in got] == [float(min(i + 1, 29)) for i in range(40)]


def _adi(spark, deficits, sst=16.0):
    rows = [(1, f"2024-01-{i + 1:02d}", 10.0 if x else 100.0, sst) for i, x in enumerate(deficits)]
    got = labels.adi_index(days(spark, rows, "cell INT, date STRING, din DOUBLE, sst DOUBLE"), ["cell"]).orderBy("date").collect()
    return [r["adi"] for r in got]


def test_adi_rises_and_decays(spark):
    assert _adi(spark, [1, 1, 0, 1]) == pytest.approx([1.5, 3.0, 0.6, 2.1])
    assert _adi(spark, [1] * 7) == pytest.approx([1.5, 3.0, 4.5, 6.0, 7.5, 9.0, 10.0])


def test_gradient_of_a_row(spark):
    df = days(spark, [("2024-01-01", 0, c, v) for c, v in enumerate([1.0, 2.0, 4.0])], "date STRING, row_idx INT, col_idx INT, sst DOUBLE")
    got = spatial.spatial_gradient(df, "sst").orderBy("col_idx").collect()
    assert [r["gradient"] for r in got] == [1.0, 1.5, 2.0]


def test_rank_normalize(spark):
    df = spark.createDataFrame([(0, 3.0), (1, 1.0), (2, 2.0)], "id INT, s DOUBLE")
    got = evaluation.rank_normalize(df, "s", "id", "r").orderBy("id").collect()
    assert [r["r"] for r in got] == [1.0, 0.0, 0.5]


def test_recall100(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.4), (0, 0.3)], "y INT, s DOUBLE")
    r = evaluation.recall100(df, "s", "y").first()
    assert (r["threshold"], r["recall"]) == (0.4, 1.0)
    assert r["precision"] == pytest.approx(2 / 3) and r["f1"] == pytest.approx(0.8)


def test_auc_and_ap_of_one_class_are_missing(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8)], "y INT, s DOUBLE")
    assert evaluation.roc_auc(df, "s", "y").first()["auc"] is None
    assert evaluation.average_precision(df, "s", "y").first()["ap"] is None


def test_drift(spark):
    df = spark.createDataFrame([(s,) for s in [0] * 60 + [1] * 10 + [2] * 10 + [3] * 10 + [4] * 10], "stage INT")
    r = evaluation.drift_score(df, [0.2] * 5).first()
    assert r["chi2_drift"] == pytest.approx(1.0, abs=1e-6) and r["is_drift"]
    assert evaluation.drift_score(df.limit(20), [0.2] * 5).first()["chi2_drift"] is None


def test_interpolation_weights(spark):
    points = spark.createDataFrame([(1, 1, 0.01, 0.0, 10.0), (1, 2, -0.02, 0.0, 20.0)], "g INT, loc_id INT, lat DOUBLE, lon DOUBLE, value DOUBLE")
    got = interpolation.interpolate_grid(points, (0.0, 1.0, 0.0, 1.0), 2, 2, ("g",)).filter("row_idx = 0 AND col_idx = 0").first()
    assert got["value"] == pytest.approx(12.0) and got["n_points"] == 2


def test_warn_class(spark):
    assert [one(spark, risk.warn_class(F.lit(w))) for w in (0.5, 0.2, 0.19)] == ["sustained", "watch", "normal"]


def test_zone_codes(spark):
    farms = spark.createDataFrame([(i, 1, 35.0 - i / 10, 126.0) for i in range(10)], "farm INT, region INT, lat DOUBLE, lon DOUBLE")
    got = [r["zone"] for r in tables.zone_codes(farms, "region", "farm").orderBy("farm").collect()]
    assert got == [f"A-{i:02d}" for i in range(1, 10)] + ["B-01"]


def test_policy(spark):
    df = spark.createDataFrame(
        [("raw_sensor", {"din": "1"}), ("llm_context", {"owner_name": "x", "a": "1", "b": "2", "c": "3", "din": "4"}), ("list", {"din": "4"})],
        "request_type STRING, payload MAP<STRING, STRING>",
    )
    got = governance.policy_evaluate(df).collect()
    assert [(r["action"], len(r["removed"]), r["risk_level"]) for r in got] == [("block", 0, "high"), ("filtered", 4, "medium"), ("allow", 0, "low")]
    assert got[1]["kept"] == {"din": "4"}


def test_scrub(spark):
    assert one(spark, tx.scrub_pii(F.lit("010-1234-5678 a@b.kr 34.123456"))) == "[PHONE] [EMAIL] [COORD]"


def test_episode_holdout(spark):
    df = spark.createDataFrame([(69,), (70,), (100,)], "t INT")
    got = dataset.episode_holdout(df, F.lit(100)).orderBy("t").collect()
    assert [r["split"] for r in got] == ["train", "purge", "val"]


def test_previous_date(spark):
    df = days(spark, [("2024-01-01",), ("2024-01-04",), ("2024-01-08",)], "date STRING")
    got = [str(r["prev_date"]) for r in temporal.previous_date(df).orderBy("date").collect()]
    assert got == ["None", "2024-01-01", "None"]


def test_chunking(spark):
    short, sentence = "a" * 30, "b" * 700 + "."
    text = f"{short}\n\n{short}\n\n{sentence} {sentence} tail"
    chunks = one(spark, tx.chunk_text(F.lit(text)))
    assert chunks == [f"{short}\n{short}", sentence, f"{sentence} tail"]
    assert one(spark, tx.chunk_text(F.lit("x" * 1200))) == ["x" * 1200]


def test_weights_sum_to_one():
    from tidewater.functions import fixed_values as fx

    assert sum(fx.RISK_WEIGHTS.values()) == pytest.approx(1.0)
    assert len(fx.CHANNELS) == 32 and fx.BAD_PIXEL_MASK == 0x327


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k INT, v STRING")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k INT, v STRING")
    first = tables.upsert(old, new, ["k"])
    again = tables.upsert(first, new, ["k"])
    want = [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, first.collect())) == want == sorted(map(tuple, again.collect()))


def test_norm_stats_of_an_empty_channel(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "channel STRING, value DOUBLE")
    got = {r["channel"]: (r["n"], r["mean"], r["std"], r["min"], r["max"]) for r in cube.norm_stats(df).collect()}
    assert got["a"] == (0, 0.0, 1.0, 0.0, 0.0) and got["b"] == (1, 2.0, 1e-8, 2.0, 2.0)


def test_fill_cube_leaves_no_gap(spark):
    from tidewater.functions import fixed_values as fx

    df = spark.range(3).select(
        F.expr("date_add(DATE '2024-01-01', CAST(id AS INT))").alias("date"), F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"),
        *[F.when(F.col("id") == 1, F.lit(5.0)).alias(c) if i else F.lit(None).cast("double").alias(c) for i, c in enumerate(fx.CHANNELS)],
    )
    got = cube.fill_cube(df).orderBy("date").collect()
    assert all(r["sst"] == 0.0 and r["mld"] == 5.0 for r in got)


def test_merge_packs_prefers_the_later(spark):
    a = spark.createDataFrame([("2024-01-01", 1, 0.1), ("2024-01-01", 2, 0.2)], "date STRING, gid INT, warn DOUBLE")
    b = spark.createDataFrame([("2024-01-01", 2, 0.9)], "date STRING, gid INT, warn DOUBLE")
    got = sorted((r["gid"], r["warn"]) for r in packs.merge_packs([a, b]).collect())
    assert got == [(1, 0.1), (2, 0.9)]
