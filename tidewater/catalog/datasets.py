"""Training-set preparation over the labelled daily grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cube as cb
from ..operators import dataset as ds
from .base import cte, cte_recursive, day, query, r6, table, view
from .seasons import _LABELS, adi_labelled

_AREA = _LABELS + """, fr AS (SELECT date, count(*) FILTER (WHERE label >= 0) AS valid_cells, coalesce(count(*) FILTER (WHERE label >= 1) / nullif(count(*) FILTER (WHERE label >= 0), 0)::DOUBLE, 0) AS f1, coalesce(count(*) FILTER (WHERE label >= 2) / nullif(count(*) FILTER (WHERE label >= 0), 0)::DOUBLE, 0) AS f2,
   coalesce(count(*) FILTER (WHERE label >= 3) / nullif(count(*) FILTER (WHERE label >= 0), 0)::DOUBLE, 0) AS f3 FROM lab GROUP BY 1),
 st AS (SELECT *, CAST(row_number() OVER (ORDER BY date) - 1 AS INT) AS t, count(*) OVER () AS total FROM fr),
 wl0 AS (SELECT t, date, total, max(valid_cells) OVER w AS v, max(f1) OVER w AS m1, max(f2) OVER w AS m2, max(f3) OVER w AS m3 FROM st WINDOW w AS (ORDER BY t ROWS BETWEEN 24 FOLLOWING AND 30 FOLLOWING)),
 wl AS (SELECT t, date, CAST(CASE WHEN v = 0 THEN -1 WHEN m3 >= 0.01 THEN 3 WHEN m2 >= 0.01 THEN 2 WHEN m1 >= 0.01 THEN 1 ELSE 0 END AS INT) AS label FROM wl0 WHERE t <= total - 31),
 starts AS (SELECT * FROM wl WHERE label > 0 OR (label = 0 AND t % 6 = 0))"""
_SPLIT = _AREA + ", spl AS (SELECT t, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY t) <= floor(count(*) OVER (PARTITION BY label) * 0.8) THEN 'train' ELSE 'val' END AS split FROM starts)"
_BOUND = "(SELECT min(t) FROM st WHERE date >= DATE '2000-06-01')"
_HOLD = _AREA + f", hold AS (SELECT t, label, CASE WHEN t + 31 <= {_BOUND} THEN 'train' WHEN t >= {_BOUND} THEN 'val' ELSE 'purge' END AS split FROM starts)"


def window_labels(spark, d):
    return ds.window_labels_area(cb.area_fraction(adi_labelled(spark, d)))


def starts(spark, d):
    return ds.window_starts(window_labels(spark, d))


def split(spark, d):
    return ds.stratified_split(starts(spark, d))


@query("window_labels_area", cte_recursive("v_dense") + _AREA + " SELECT t, CAST(date AS VARCHAR) AS date, label FROM wl")
def window_labels_area(spark, d):
    return window_labels(spark, d).select("t", day(), "label")


@query("window_starts", cte_recursive("v_dense") + _AREA + " SELECT t, label FROM starts")
def window_starts(spark, d):
    return starts(spark, d).select("t", "label")


@query("stratified_split", cte_recursive("v_dense") + _SPLIT + " SELECT t, label, split FROM spl")
def stratified_split(spark, d):
    return split(spark, d).select("t", "label", "split")


def _holdout(spark, d):
    days = adi_labelled(spark, d).select("date").distinct()
    boundary = ds.number_days(days).filter(F.col("date") >= F.lit("2000-06-01").cast("date")).select(F.min("t")).scalar()
    return ds.episode_holdout(starts(spark, d), boundary)


@query("episode_holdout", cte_recursive("v_dense") + _HOLD + " SELECT t, label, split FROM hold")
def episode_holdout(spark, d):
    return _holdout(spark, d).select("t", "label", "split")


@query("oversample_minor", cte_recursive("v_dense") + _SPLIT + " SELECT t, label, split, CAST(copy AS INT) AS copy FROM (SELECT *, unnest(range(1, CASE WHEN label IN (1, 2, 3) AND split = 'train' THEN 4 ELSE 2 END)) AS copy FROM spl)")
def oversample_minor(spark, d):
    return ds.oversample_minor(split(spark, d), 3).select("t", "label", "split", "copy")


@query("split_histogram", cte_recursive("v_dense") + _SPLIT + " SELECT split, label, count(*) AS n FROM spl GROUP BY 1, 2")
def split_histogram(spark, d):
    return split(spark, d).groupBy("split", "label").agg(F.count("*").alias("n"))


@query("split_leakage", cte_recursive("v_dense") + _SPLIT + ", c AS (SELECT split, unnest(range(t, t + 31)) AS u FROM spl) SELECT DISTINCT CAST(u AS INT) AS t FROM c a WHERE split = 'train' AND EXISTS (SELECT 1 FROM c b WHERE b.split = 'val' AND b.u = a.u)")
def split_leakage(spark, d):
    return ds.split_leakage(split(spark, d))


@query("future_max", cte("v_daily") + "SELECT CAST(date AS VARCHAR) AS date, cell_id, round(max(din) OVER (PARTITION BY cell_id ORDER BY date ROWS BETWEEN 24 FOLLOWING AND 30 FOLLOWING), 6) AS future_max FROM v_daily")
def future_max(spark, d):
    return ds.future_max(view(spark, d, "v_daily"), ["cell_id"], "din").select(day(), "cell_id", r6("future_max"))


@query(
    "sliding_windows",
    cte("v_daily") + """, w AS (SELECT date, cell_id, count(*) OVER a AS n_in, avg(din) OVER a AS din_mean, avg(sst) OVER a AS sst_mean, count(*) OVER b AS n_out, max(din) OVER b AS y_max FROM v_daily
    WINDOW a AS (PARTITION BY cell_id ORDER BY date ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING), b AS (PARTITION BY cell_id ORDER BY date ROWS BETWEEN 24 FOLLOWING AND 30 FOLLOWING))
    SELECT CAST(date AS VARCHAR) AS date, cell_id, 24 AS t_in, 7 AS t_out, round(din_mean, 6) AS din_mean, round(sst_mean, 6) AS sst_mean, round(y_max, 6) AS y_max FROM w WHERE n_in = 24 AND n_out = 7""",
)
def sliding_windows(spark, d):
    w = ds.sliding_windows(view(spark, d, "v_daily"), ["cell_id"], ["din", "sst"], "din")
    total = lambda f: F.aggregate("x", F.lit(0.0), lambda a, s: a + s[f])
    return w.select(
        day(), "cell_id", F.size("x").alias("t_in"), F.size("y").alias("t_out"), r6(total("din") / F.size("x"), "din_mean"),
        r6(total("sst") / F.size("x"), "sst_mean"), r6(F.array_max("y"), "y_max"),
    )


@query(
    "quantile_bins",
    cte("v_daily") + ", q AS (SELECT quantile_cont(din, 0.5) AS a, quantile_cont(din, 0.8) AS b, quantile_cont(din, 0.95) AS c FROM v_daily) SELECT CAST(date AS VARCHAR) AS date, cell_id, CAST((din >= a) AS INT) + CAST((din >= b) AS INT) + CAST((din >= c) AS INT) AS bin FROM v_daily, q",
)
def quantile_bins(spark, d):
    return ds.quantile_bins(view(spark, d, "v_daily"), "din", [0.5, 0.8, 0.95]).select(day(), "cell_id", "bin")


@query("hash_split", "SELECT event_id, CASE WHEN (event_id * 2654435761) % 1000 // 10 < 80 THEN 'train' ELSE 'val' END AS split FROM events")
def hash_split(spark, d):
    bucket = F.floor((F.col("event_id") * 2654435761) % 1000 / 10)
    return ds.hash_split(table(spark, d, "events"), bucket).select("event_id", "split")


@query(
    "sample_per_label",
    cte("v_daily") + """, l AS (SELECT date, cell_id, CASE WHEN din <= 20 THEN 3 WHEN din <= 40 THEN 2 WHEN din <= 70 THEN 1 ELSE 0 END AS label FROM v_daily), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ((date - DATE '1970-01-01') * 31 + cell_id) * 2654435761 % 1000, date, cell_id) AS k FROM l)
    SELECT CAST(date AS VARCHAR) AS date, cell_id, CAST(label AS INT) AS label FROM k WHERE k <= 20""",
)
def sample_per_label(spark, d):
    din = F.col("din")
    labelled = view(spark, d, "v_daily").withColumn("label", F.when(din <= 20, 3).when(din <= 40, 2).when(din <= 70, 1).otherwise(0))
    order = (F.unix_date("date").cast("bigint") * 31 + F.col("cell_id")) * 2654435761 % 1000
    return ds.sample_per_label(labelled, "label", [order, F.col("date"), F.col("cell_id")], 20).select(day(), "cell_id", "label")
