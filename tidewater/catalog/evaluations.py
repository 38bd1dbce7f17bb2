"""Model evaluation and monitoring over the score table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.risk import risk_index_molar
from ..operators import evaluation as ev
from ..operators import labels as lb
from .base import cte, cte_recursive, query, r6, view
from .seasons import _ADI, _cells

_S = cte("v_scores")


def scores(spark, d):
    return view(spark, d, "v_scores")


@query(
    "eval_regression",
    _S + "SELECT farm_id, round(avg(abs(warn * 10 - stage * 2)), 6) AS mae, round(sqrt(avg((warn * 10 - stage * 2) * (warn * 10 - stage * 2))), 6) AS rmse, count(*) AS n_valid FROM v_scores WHERE pred_id % 10 <> 0 GROUP BY 1",
)
def eval_regression(spark, d):
    """Every tenth target is marked -1 and must not count."""
    df = scores(spark, d).select(
        "farm_id", (F.col("warn") * 10).alias("p"), F.when(F.col("pred_id") % 10 == 0, -1.0).otherwise(F.col("stage") * 2.0).alias("a")
    )
    return ev.regression_error(df, "p", "a", ["farm_id"]).select("farm_id", r6("mae"), r6("rmse"), "n_valid")


@query(
    "eval_binary",
    cte_recursive("v_dense") + _ADI + """, h AS (SELECT cell_id, season, date, max(adi) OVER (PARTITION BY cell_id, season ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING) AS m FROM walk)
    SELECT CAST(season AS INT) AS season, count(m) AS n_valid, count(*) FILTER (WHERE m >= 5) AS n_warn, count(*) FILTER (WHERE m >= 8) AS n_severe, round(count(*) FILTER (WHERE m >= 5) / count(m)::DOUBLE, 6) AS warn_rate FROM h GROUP BY 1""",
)
def eval_binary(spark, d):
    adi = lb.adi_index(_cells(spark, d), ["cell_id"])
    ahead = Window.partitionBy("cell_id", "season").orderBy("date").rowsBetween(1, 7)
    m = adi.withColumn("m", F.max("adi").over(ahead))
    return m.groupBy("season").agg(
        F.count("m").alias("n_valid"), F.count_if(F.col("m") >= 5).alias("n_warn"), F.count_if(F.col("m") >= 8).alias("n_severe"),
        r6(F.count_if(F.col("m") >= 5) / F.count("m"), "warn_rate"),
    )


@query(
    "eval_auc",
    _S + """, g AS (SELECT warn, sum(y_true) AS pos, sum(1 - y_true) AS neg FROM v_scores GROUP BY 1), r AS (SELECT *, sum(neg) OVER (ORDER BY warn) - neg AS below FROM g)
    SELECT round(sum(pos * below + pos * neg / 2.0)::DOUBLE / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 6) AS auc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM r""",
)
def eval_auc(spark, d):
    return ev.roc_auc(scores(spark, d), "warn", "y_true").select(r6("auc"), "n_pos", "n_neg")


@query(
    "eval_ap",
    _S + """, g AS (SELECT warn, sum(y_true) AS pos, count(*) AS n FROM v_scores GROUP BY 1), r AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY warn DESC))
    SELECT round(sum(pos::DOUBLE * tp::DOUBLE / seen::DOUBLE) / sum(pos)::DOUBLE, 6) AS ap FROM r""",
)
def eval_ap(spark, d):
    return ev.average_precision(scores(spark, d), "warn", "y_true").select(r6("ap"))


_F1 = "count(*) FILTER (WHERE {h} AND y_true = 1) AS tp, count(*) FILTER (WHERE {h} AND y_true = 0) AS fp, count(*) FILTER (WHERE NOT ({h}) AND y_true = 1) AS fn"
_PRF = "round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0 * tp::DOUBLE / (2 * tp + fp + fn), 6) AS f1"


@query("eval_f1", _S + ", c AS (SELECT " + _F1.format(h="warn >= 0.5") + " FROM v_scores) SELECT tp, fp, fn, " + _PRF + " FROM c")
def eval_f1(spark, d):
    return ev.f1_at(scores(spark, d), "warn", "y_true").select("tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


@query("eval_corr", _S + "SELECT round(corr(warn, latency_ms), 6) AS corr FROM v_scores")
def eval_corr(spark, d):
    return ev.guarded_corr(scores(spark, d), "warn", "latency_ms").select(r6("corr"))


@query("latency_stats", _S + "SELECT farm_id, round(avg(latency_ms), 6) AS mean_ms, count(*) AS n, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms FROM v_scores GROUP BY 1")
def latency_stats(spark, d):
    return ev.latency_stats(scores(spark, d), "latency_ms", ["farm_id"]).select("farm_id", r6("mean_ms"), "n", r6("p95_ms"))


@query(
    "rank_normalize",
    _S + "SELECT pred_id, round((row_number() OVER (ORDER BY stage, pred_id) - 1)::DOUBLE / (count(*) OVER () - 1), 6) AS r_stage, round((row_number() OVER (ORDER BY warn, pred_id) - 1)::DOUBLE / (count(*) OVER () - 1), 6) AS r_warn FROM v_scores",
)
def rank_normalize(spark, d):
    ranked = ev.rank_normalize(ev.rank_normalize(scores(spark, d), "stage", "pred_id", "r_stage"), "warn", "pred_id", "r_warn")
    return ranked.select("pred_id", r6("r_stage"), r6("r_warn"))


_POS = "warn >= (SELECT min(warn) FROM v_scores WHERE y_true = 1)"


@query("recall100_f1", _S + ", c AS (SELECT round((SELECT min(warn) FROM v_scores WHERE y_true = 1), 6) AS threshold, " + _F1.format(h=_POS) + " FROM v_scores) SELECT threshold, tp, fp, fn, " + _PRF + " FROM c")
def recall100_f1(spark, d):
    r = ev.recall100(scores(spark, d), "warn", "y_true")
    return r.select(r6("threshold"), "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


@query(
    "alpha_sweep",
    _S + """, r AS (SELECT y_true, (row_number() OVER (ORDER BY warn, pred_id) - 1)::DOUBLE / (count(*) OVER () - 1) AS r1, (row_number() OVER (ORDER BY stage, pred_id) - 1)::DOUBLE / (count(*) OVER () - 1) AS r2 FROM v_scores),
    m AS (SELECT i / 10.0::DOUBLE AS alpha, y_true, (i / 10.0::DOUBLE) * r1 + (1.0::DOUBLE - i / 10.0::DOUBLE) * r2 AS mix FROM r CROSS JOIN (SELECT unnest(range(11)) AS i)),
    t AS (SELECT alpha, min(mix) FILTER (WHERE y_true = 1) AS thr FROM m GROUP BY 1), c AS (SELECT m.alpha, count(*) FILTER (WHERE mix >= thr AND y_true = 1) AS tp, count(*) FILTER (WHERE mix >= thr AND y_true = 0) AS fp, CAST(0 AS BIGINT) AS fn FROM m JOIN t ON t.alpha = m.alpha GROUP BY 1),
    f AS (SELECT *, 2.0 * tp::DOUBLE / (2 * tp + fp + fn) AS f FROM c)
    SELECT round(alpha, 1) AS alpha, tp, fp, round(f, 6) AS f1, round(f, 9) = (SELECT round(max(f), 9) FROM f) AS is_best, round(alpha, 1) = 1.0 AS is_baseline FROM f""",
)
def alpha_sweep(spark, d):
    s = ev.alpha_sweep(scores(spark, d), "warn", "stage", "y_true", "pred_id")
    return s.select("alpha", "tp", "fp", r6("f1"), "is_best", "is_baseline")


@query(
    "drift_score",
    _S + """, c AS (SELECT count(*) AS n, round(count(*) FILTER (WHERE stage = 0)::DOUBLE / count(*), 4) AS s0, round(count(*) FILTER (WHERE stage = 1)::DOUBLE / count(*), 4) AS s1, round(count(*) FILTER (WHERE stage = 2)::DOUBLE / count(*), 4) AS s2,
      round(count(*) FILTER (WHERE stage = 3)::DOUBLE / count(*), 4) AS s3, round(count(*) FILTER (WHERE stage = 4)::DOUBLE / count(*), 4) AS s4 FROM v_scores),
    k AS (SELECT *, abs(list_sum(list_transform([s0, s1, s2, s3, s4], lambda c: c * (c / (0.2 + 1e-8) + 1e-8))) - 1) AS x FROM c) SELECT n, s0 AS share_0, s1 AS share_1, s2 AS share_2, s3 AS share_3, s4 AS share_4, round(x, 6) AS chi2_drift, x > 0.3 AS is_drift FROM k""",
)
def drift_score(spark, d):
    s = ev.drift_score(scores(spark, d), [0.2] * 5)
    return s.select("n", *[f"share_{i}" for i in range(5)], r6("chi2_drift"), "is_drift")


@query(
    "perf_summary",
    _S + """, o AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS i, count(*) OVER () AS n FROM v_scores) SELECT count(*) AS n, round(avg(latency_ms), 6) AS latency_mean, round(avg(warn), 6) AS score_mean, round(stddev_samp(warn), 6) AS score_stdev, round(min(warn), 6) AS score_min, round(max(warn), 6) AS score_max,
    (SELECT latency_ms FROM o WHERE i = least(n * 50 // 100, n - 1)) AS latency_p50, (SELECT latency_ms FROM o WHERE i = least(n * 95 // 100, n - 1)) AS latency_p95, (SELECT latency_ms FROM o WHERE i = least(n * 99 // 100, n - 1)) AS latency_p99 FROM v_scores""",
)
def perf_summary(spark, d):
    s = ev.perf_summary(scores(spark, d), "latency_ms", "warn")
    names = ("latency_mean", "score_mean", "score_stdev", "score_min", "score_max")
    return s.select("n", *[r6(c) for c in names], "latency_p50", "latency_p95", "latency_p99")


@query(
    "perf_rolling",
    _S + """, w AS (SELECT pred_id, count(*) OVER v AS win_n, avg(latency_ms) OVER v AS lm, avg(warn) OVER v AS sm, stddev_samp(warn) OVER v AS sd, list(latency_ms) OVER v AS l FROM v_scores WINDOW v AS (PARTITION BY farm_id % 7 ORDER BY pred_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))
    SELECT pred_id, win_n, round(lm, 6) AS latency_mean, round(sm, 6) AS score_mean, round(coalesce(sd, 0), 6) AS score_stdev, list_sort(l)[CAST(least(win_n * 50 // 100, win_n - 1) + 1 AS INT)] AS latency_p50, list_sort(l)[CAST(least(win_n * 95 // 100, win_n - 1) + 1 AS INT)] AS latency_p95 FROM w""",
)
def perf_rolling(spark, d):
    """Trailing 200 inferences of each of seven models."""
    df = scores(spark, d).withColumn("model", F.col("farm_id") % 7)
    r = ev.perf_rolling(df, ["model"], [("pred_id", True)], "latency_ms", "warn")
    return r.select("pred_id", "win_n", r6("latency_mean"), r6("score_mean"), r6("score_stdev"), "latency_p50", "latency_p95")


@query(
    "paired_diff",
    _S + ", g AS (SELECT abs(warn - latency_ms / (latency_ms + 40)) AS gap FROM v_scores) SELECT count(*) AS n, round(avg(gap), 6) AS mean_diff, round(max(gap), 6) AS max_diff, round(quantile_cont(gap, 0.95), 6) AS p95_diff FROM g",
)
def paired_diff(spark, d):
    s = scores(spark, d)
    other = s.select("pred_id", (F.col("latency_ms") / (F.col("latency_ms") + 40)).alias("warn"))
    return ev.paired_diff(s, other, "pred_id", "warn").select("n", r6("mean_diff"), r6("max_diff"), r6("p95_diff"))


@query(
    "metric_compare",
    _S + """, a AS (SELECT 'farm_' || CAST(farm_id AS VARCHAR) AS metric, avg(warn) AS v FROM v_scores WHERE stage < 4 AND farm_id % 5 <> 0 GROUP BY 1), b AS (SELECT 'farm_' || CAST(farm_id AS VARCHAR) AS metric, avg(warn) AS v FROM v_scores WHERE farm_id % 3 <> 0 GROUP BY 1)
    SELECT metric, round(a.v, 6) AS value_a, round(b.v, 6) AS value_b, round(b.v - a.v, 6) + 0.0 AS delta FROM a FULL JOIN b USING (metric)""",
)
def metric_compare(spark, d):
    """Metrics of two model versions; some metrics exist in one version only."""
    named = scores(spark, d).withColumn("metric", F.concat(F.lit("farm_"), F.col("farm_id").cast("string")))
    means = lambda df: df.groupBy("metric").agg(F.avg("warn").alias("value"))
    c = ev.metric_compare(means(named.filter("stage < 4 AND farm_id % 5 <> 0")), means(named.filter("farm_id % 3 <> 0")))
    return c.select("metric", r6("value_a"), r6("value_b"), r6("delta"))


_PI = "least(1.0, greatest(0.0, 0.38 * greatest(0.0, 1 - {din} / 14 / 5) + 0.27 * greatest(0.0, ({sst} - 20) / 10)))"


@query(
    "permutation_importance",
    cte("v_daily") + """, k AS (SELECT CAST(date - DATE '1970-01-01' AS BIGINT) * 25 + cell_id AS id, din, sst, CASE WHEN din <= 35 THEN 1 ELSE 0 END AS y FROM v_daily),
    b AS (SELECT *, row_number() OVER (ORDER BY id) AS pos FROM k), dn AS (SELECT din AS ddin, sst AS dsst, row_number() OVER (ORDER BY (id * 2654435761) % 1000003, id) AS pos FROM k),
    x AS (SELECT f.feature, y, CASE WHEN feature = 'din' THEN ddin ELSE din END AS din, CASE WHEN feature = 'sst' THEN dsst ELSE sst END AS sst FROM b JOIN dn USING (pos) CROSS JOIN (VALUES ('baseline'), ('din'), ('sst')) f(feature)),
    c AS (SELECT feature, count(*) FILTER (WHERE s >= 0.2 AND y = 1) AS tp, count(*) FILTER (WHERE s >= 0.2 AND y = 0) AS fp, count(*) FILTER (WHERE s < 0.2 AND y = 1) AS fn FROM (SELECT feature, y, """ + _PI.format(din="din", sst="sst") + """ AS s FROM x) GROUP BY 1), r AS (SELECT feature, 2.0 * tp / (2 * tp + fp + fn)::DOUBLE AS f1 FROM c)
    SELECT feature, round(f1, 6) AS f1, round((SELECT f1 FROM r WHERE feature = 'baseline') - f1, 6) + 0.0 AS drop FROM r""",
)
def permutation_importance(spark, d):
    daily = view(spark, d, "v_daily").select(
        (F.unix_date("date").cast("bigint") * 25 + F.col("cell_id")).alias("id"), "din", "sst", F.when(F.col("din") <= 35, 1).otherwise(0).alias("y")
    )
    none = F.lit(None).cast("double")
    score = lambda c: risk_index_molar(c["din"] / 14, c["sst"], none, none, none)
    p = ev.permutation_importance(daily, "id", ["din", "sst"], (F.col("id") * 2654435761) % 1000003, score, "y", 0.2)
    return p.select("feature", r6("f1"), r6("drop"))
