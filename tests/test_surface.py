"""SQL functions, table functions, the scoring slot, readers and sinks."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions import geo, numeric, registry, risk, seasons, udfs
from tidewater.operators import labels, quality, temporal
from tidewater.plans import frames
from tidewater.sources import landed
from tidewater.sources import tables as st


def test_sql_functions(spark):
    names = registry.register_sql_functions(spark)
    assert "tw_risk_stage" in names
    r = spark.sql(
        "SELECT tw_risk_stage(0.6D) s, tw_guarded_ratio(1D, 0D) g, tw_sum_present(NULL, 2D) p, tw_clamp(7D, 0D, 5D) c, tw_in_season(DATE '2024-07-01') i"
    ).first()
    assert tuple(r) == (3, None, 2.0, 5.0, False)


def test_sql_functions_equal_the_columns(spark):
    registry.register_sql_functions(spark)
    df = spark.sql("""SELECT * FROM VALUES (0.0D, 2.5D, DATE '2024-11-02'), (-3.25D, 0.125D, DATE '2024-02-29'), (17.0D, 0.0D, DATE '2023-07-31'), (0.85D, 12.345D, DATE '2025-05-01')
        AS t(a, b, d)""")
    a, b, d = F.col("a"), F.col("b"), F.col("d")
    same = {
        "tw_falsy_coalesce(a, b, 9D)": numeric.falsy_coalesce(a, b, default=9.0), "tw_within(a, 0D, 1D)": numeric.within(a, 0.0, 1.0),
        "tw_round_half_up(b, 2)": numeric.round_half_up(b, 2), "tw_round_half_up(a, 1)": numeric.round_half_up(a, 1), "tw_wind_sin(a)": numeric.wind_vector(a)[0], "tw_wind_cos(a)": numeric.wind_vector(a)[1],
        "tw_month_sin(d)": numeric.month_cycle(d)[0], "tw_month_cos(d)": numeric.month_cycle(d)[1], "tw_squared_degrees(a, b, b, a)": geo.squared_degrees(a, b, b, a),
        "tw_great_circle_km(a, b, b, a)": geo.great_circle_km(a, b, b, a), "tw_season_id(d)": seasons.season_id(d), "tw_season_name(d)": seasons.season_name(d),
        "tw_sst_weight(a)": seasons.sst_weight(a), "tw_severity_band(a)": risk.severity_band(a), "tw_nutrient_status(a, 0D, 1D)": risk.nutrient_status(a, 0.0, 1.0),
        "tw_risk_din_only(a)": risk.risk_index_din_only(a), "tw_clamp(a, 0D, 1D)": numeric.clamp(a, 0.0, 1.0), "tw_risk_stage(a)": risk.risk_stage(a),
    }
    row = df.select(*[F.struct(F.collect_list(F.expr(s)).alias("x"), F.collect_list(c).alias("y")).alias(f"f{i}") for i, (s, c) in enumerate(same.items())]).first()
    for name, pair in zip(same, row):
        assert all(p == q or abs(p - q) <= 1e-12 * abs(q) + 1e-15 for p, q in zip(pair.x, pair.y, strict=True)), name


def test_table_functions(spark):
    udfs.register_table_functions(spark)
    payloads = [(1, '{"body":{"item":[{"a":1},{"a":2}]}}'), (2, "not json"), (3, None), (4, '{"Item":{"a":"é"}}'), (5, '{"x":1}'), (None, '{"item":[]}')]
    spark.createDataFrame(payloads, "id INT, payload STRING").createOrReplaceTempView("landed_payloads")
    rows = spark.sql("SELECT * FROM tw_envelope_items(TABLE(landed_payloads) PARTITION BY (id), 'payload')").collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, '{"a":1}'), (1, 1, '{"a":2}'), (4, 0, '{"a":"é"}')]
    spark.createDataFrame([("a\n\nb\n\n\n",), (None,)], "text STRING").createOrReplaceTempView("some_texts")
    assert spark.sql("SELECT count(*) n FROM tw_paragraphs(TABLE(some_texts), 'text')").first()["n"] == 2
    with pytest.raises(Exception, match="column of t"):
        spark.sql("SELECT * FROM tw_paragraphs(TABLE(some_texts), 'other')").collect()


def test_scoring_slot(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, 5.0)], "id INT, a DOUBLE, b DOUBLE")
    got = udfs.score_rows(df, ["a", "b"], lambda m: m[:, 0] * 10 + m[:, 1]).orderBy("id").collect()
    assert [r["score"] for r in got] == [23.0, 45.0]


def test_missing_table_is_empty(spark):
    assert st.read_table(spark, frames.staging_path(spark, "nowhere"), "a INT, b STRING").count() == 0


def test_csv_and_text_readers(spark, tmp_path):
    csv = tmp_path / "windows.csv"
    csv.write_text("window_id,target_date,region,lat,lon,y_true,v19_score\nw1,2024-01-02,x,35.1,126.2,1,0.5\n")
    row = st.read_labelled_windows(spark, str(csv)).first()
    assert (row["window_id"], str(row["target_date"]), row["y_true"]) == ("w1", "2024-01-02", 1)
    doc = tmp_path / "a.md"
    doc.write_text("# T\nbody\n")
    assert st.read_text_files(spark, str(doc)).first()["text"] == "# T\nbody\n"


def test_unknown_envelope_gives_no_rows(spark):
    df = spark.createDataFrame([(1, '{"x": 1}'), (2, "not json"), (3, '{"body":{"item":{"k":1}}}')], "id INT, payload STRING")
    assert [r["id"] for r in landed.envelope_items(df, "payload", ["id"]).collect()] == [3]


def test_pack_rows_accept_both_forms(spark):
    df = spark.createDataFrame([('{"2024-01-01":{"7":2,"8":{"stage":1,"warn":0.4,"adi7":[1.0]}}}',)], "document STRING")
    got = {r["gid"]: (r["stage"], r["warn"]) for r in landed.pack_rows(df, "document", []).collect()}
    assert got == {"7": (2, None), "8": (1, 0.4)}


def test_days_written_again_are_replaced(spark):
    path = frames.staging_path(spark, "daily")
    write = lambda v, d: st.write_by_day(spark.createDataFrame([(v, d)], "v INT, date STRING"), path)
    write(1, "2024-01-01")
    write(2, "2024-01-02")
    write(3, "2024-01-02")
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 3]


def test_detector_equals_a_replay_in_arrival_order(spark):
    """The window form of the detector against a row-by-row replay inside a grouped map."""
    df = spark.range(400).select(
        "id", (F.col("id") % 2).alias("sensor"), F.lit("din").alias("field"),
        (F.lit(100.0) + F.sin(F.col("id")) * 5 + F.when(F.col("id") % 97 == 0, 300.0).otherwise(0.0)).alias("value"),
    )

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        out, window, prev = [], [], None
        for row in pdf.sort_values("id").itertuples():
            past = pd.Series(window[-50:], dtype="float64")
            kinds = []
            if len(past) >= 10:
                std = past.std(ddof=0)
                z = abs(row.value - past.mean()) / std if std > 1e-6 else 0.0
                q1, q3 = past.quantile(0.25), past.quantile(0.75)
                if z > 3:
                    kinds.append("z_score")
                elif row.value < q1 - 1.5 * (q3 - q1) or row.value > q3 + 1.5 * (q3 - q1):
                    kinds.append("iqr")
            if prev is not None and abs(prev) > 1e-6 and abs(row.value - prev) / abs(prev) > 3:
                kinds.append("spike")
            out += [(row.id, k) for k in kinds]
            window.append(row.value)
            prev = row.value
        return pd.DataFrame(out, columns=["id", "anomaly_type"])

    want = df.groupBy("sensor").applyInPandas(replay, "id BIGINT, anomaly_type STRING")
    got = quality.flag_outliers(df, ["sensor"], [("id", True)]).filter(F.col("anomaly_type").isin("z_score", "iqr", "spike"))
    assert want.count() > 0
    assert sorted(map(tuple, got.select("id", "anomaly_type").collect())) == sorted(map(tuple, want.collect()))


def test_index_continues_from_a_carried_value(spark):
    rows = [(1, f"2024-01-{i + 1:02d}", 10.0 if i % 4 else 100.0, 16.0) for i in range(20)]
    df = spark.createDataFrame(rows, "cell INT, date STRING, din DOUBLE, sst DOUBLE").withColumn("date", F.col("date").cast("date"))
    whole = {r["date"]: r["adi"] for r in labels.adi_index(df, ["cell"]).collect()}
    head = labels.adi_index(df.filter("date < '2024-01-11'"), ["cell"])
    carry = head.groupBy("cell", "season").agg(F.max_by("adi", "date").alias("adi"))
    tail = labels.adi_index(df.filter("date >= '2024-01-11'"), ["cell"], carry=carry)
    parts = {r["date"]: r["adi"] for r in head.unionByName(tail).collect()}
    assert parts == pytest.approx(whole) and all(0 <= v <= 10 for v in whole.values())


def test_interval_events_reach_into_buffers(spark):
    events = spark.sql("SELECT DATE '2024-01-10' AS start, DATE '2024-01-12' AS end")
    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-01-31')) AS date")
    got = sorted(str(r["date"]) for r in temporal.interval_events(days, events, before=2, after=1).collect())
    assert got[0] == "2024-01-08" and got[-1] == "2024-01-13" and len(got) == 6
