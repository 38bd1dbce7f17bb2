"""A key of many inferences is cut into blocks early, and its windows stay the same."""

from tidewater.operators import evaluation


def test_large_keys_are_cut(spark, monkeypatch):
    assert evaluation.perf_rolling.__defaults__[1] == evaluation.ROLLING_ROWS <= 200_000
    rows = [(i, i % 2, float(i * 37 % 101), (i * 13 % 17) / 17) for i in range(900)]
    df = spark.createDataFrame(rows, "id INT, model INT, latency DOUBLE, warn DOUBLE")
    run = lambda hot: {r.id: (r.win_n, r.latency_p50, r.latency_p95, round(r.score_mean, 9)) for r in evaluation.perf_rolling(df, ["model"], [("id", True)], "latency", "warn", 20, hot).collect()}
    assert run(100) == run(10_000)
