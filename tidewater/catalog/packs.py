"""Prediction packs built from the score table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..operators import packs as pk
from ..sources import landed
from .base import cte, day, query, r6, view

# Seven-day horizon around the first value, zero stays zero
_ADI = "CASE WHEN adi_first > 0 THEN list_transform(range(7), lambda i: adi_first * (1 + (CASE WHEN i < 4 THEN i ELSE 6 - i END) / CAST(10 AS DOUBLE))) ELSE list_transform(range(7), lambda i: CAST(0 AS DOUBLE)) END"
_PACK = cte("v_pack") + f", pack AS (SELECT date, gid, warn, severe, CAST(stage AS INT) AS stage, {_ADI} AS adi7 FROM v_pack), " \
    "oog AS (SELECT c_custkey AS gid FROM customer WHERE CAST(34 AS DOUBLE) + CAST(c_custkey * 37 % 281 AS DOUBLE) / CAST(100 AS DOUBLE) > 36.6), " \
    "masked AS (SELECT gid FROM (SELECT gid, max(list_max(adi7)) AS m FROM pack GROUP BY 1) WHERE m <= 0 UNION SELECT gid FROM oog)"
_SEASON = "month(date) NOT IN (6, 7, 8, 9, 10)"
_PREV = ", pd AS (SELECT date, CASE WHEN date - lag(date) OVER (ORDER BY date) <= 3 THEN lag(date) OVER (ORDER BY date) END AS prev_date FROM (SELECT DISTINCT date FROM pack))," \
    " ons AS (SELECT p.*, b.warn AS warn_prev, round(p.warn - b.warn, 4) AS onset FROM pack p JOIN pd USING (date) LEFT JOIN pack b ON b.gid = p.gid AND b.date = pd.prev_date)"
_CLS = _PREV + f", cls AS (SELECT o.date, o.gid, stage, CASE stage WHEN 0 THEN '정상' WHEN 1 THEN '초기' WHEN 2 THEN '경계' WHEN 3 THEN '심각' ELSE '??' END AS stage_label, m.gid IS NOT NULL AS no_coverage, CASE WHEN m.gid IS NULL THEN CASE WHEN warn >= .5 THEN 'sustained' WHEN warn >= .2 THEN 'watch' ELSE 'normal' END END AS risk, CASE WHEN m.gid IS NULL THEN warn_prev END AS warn_prev, CASE WHEN m.gid IS NULL THEN onset END AS onset FROM ons o LEFT JOIN masked m ON m.gid = o.gid WHERE {_SEASON})"


def pack(spark, d):
    base = view(spark, d, "v_pack")
    shape = lambda i: F.when(i < 4, i).otherwise(F.lit(6) - i) / F.lit(10.0)
    horizon = F.transform(
        F.sequence(F.lit(0), F.lit(6)),
        lambda i: F.when(F.col("adi_first") > 0, F.col("adi_first") * (F.lit(1.0) + shape(i))).otherwise(0.0),
    )
    return base.select("date", "gid", "warn", "severe", F.col("stage").cast("int").alias("stage"), horizon.alias("adi7"))


def out_of_grid(spark, d):
    return view(spark, d, "v_farms").filter(F.col("lat") > 36.6).select(F.col("farm_id").alias("gid"))


def masked(spark, d):
    return pk.no_coverage(pack(spark, d), out_of_grid(spark, d))


@query("pack_explode", _PACK + " SELECT CAST(date AS VARCHAR) AS date, CAST(gid AS VARCHAR) AS gid, CASE WHEN gid % 2 = 0 THEN round(warn, 6) END AS warn, stage, CASE WHEN gid % 2 = 0 THEN round(list_max(adi7), 6) END AS adi_peak FROM pack")
def pack_explode(spark, d):
    """Pack documents written with both entry forms (struct and bare stage), then read back as rows."""
    p = pack(spark, d)
    new = pk.pack_documents(p.filter("gid % 2 = 0"), farms_per_document=50).select("document")
    old = pk.pack_documents(p.filter("gid % 2 = 1"), farms_per_document=50, bare_stage=True).select("document")
    rows = landed.pack_rows(new.unionByName(old), "document", [])
    return rows.select(day(), "gid", r6("warn"), "stage", r6(F.array_max("adi7"), "adi_peak"))


@query("pack_assemble", _PACK + " SELECT CAST(date AS VARCHAR) AS date, count(*) AS n_farms, round(sum(warn), 4) AS warn_sum FROM pack GROUP BY 1")
def pack_assemble(spark, d):
    """Documents of at most about fifty farms, parsed again and totalled per date."""
    docs = pk.pack_documents(pack(spark, d), farms_per_document=50)
    back = landed.pack_rows(docs.select("document"), "document", [])
    return back.groupBy("date").agg(F.count("*").alias("n_farms"), round_half_up(F.sum("warn"), 4).alias("warn_sum")).withColumn(
        "date", F.col("date").cast("string")
    )


@query(
    "pack_merge",
    _PACK + """, a AS (SELECT date, gid, warn FROM pack WHERE gid % 3 <> 0), b AS (SELECT date, gid, warn / 2 AS warn FROM pack WHERE gid % 2 = 0)
    SELECT CAST(date AS VARCHAR) AS date, gid, round(coalesce(b.warn, a.warn), 6) AS warn FROM a FULL JOIN b USING (date, gid)""",
)
def pack_merge(spark, d):
    p = pack(spark, d).select("date", "gid", "warn")
    merged = pk.merge_packs([p.filter("gid % 3 <> 0"), p.filter("gid % 2 = 0").withColumn("warn", F.col("warn") / 2)])
    return merged.select(day(), "gid", r6("warn"))


@query("no_coverage_mask", _PACK + " SELECT gid, (SELECT count(*) FROM masked) > 0.9 * (SELECT count(DISTINCT gid) FROM pack) AS schema_alarm FROM masked")
def no_coverage_mask(spark, d):
    m = masked(spark, d)
    alarm = pk.coverage_alarm(pack(spark, d), m).select("schema_alarm").scalar()
    return m.withColumn("schema_alarm", alarm)


@query("onset_delta", _PACK + _PREV + " SELECT CAST(date AS VARCHAR) AS date, gid, round(warn_prev, 6) AS warn_prev, onset + 0.0 AS onset FROM ons")
def onset_delta(spark, d):
    return pk.onset_delta(pack(spark, d)).select(day(), "gid", r6("warn_prev"), (F.col("onset") + 0.0).alias("onset"))


@query("classify_pack", _PACK + _CLS + " SELECT CAST(date AS VARCHAR) AS date, gid, stage, stage_label, no_coverage, risk, CASE WHEN no_coverage THEN '예측 판별 불가' WHEN risk = 'sustained' THEN '고위험' WHEN risk = 'watch' THEN '주의' ELSE '정상' END AS risk_label, round(warn_prev, 6) AS warn_prev, onset + 0.0 AS onset FROM cls")
def classify_pack(spark, d):
    c = pk.classify_pack(pack(spark, d), masked(spark, d))
    return c.select(day(), "gid", "stage", "stage_label", "no_coverage", "risk", "risk_label", r6("warn_prev"), (F.col("onset") + 0.0).alias("onset"))


@query("risk_counts", _PACK + _CLS + " SELECT CAST(date AS VARCHAR) AS date, CASE WHEN no_coverage THEN 'no_coverage' ELSE risk END AS risk, count(*) AS n FROM cls GROUP BY 1, 2")
def risk_counts(spark, d):
    c = pk.classify_pack(pack(spark, d), masked(spark, d))
    return pk.risk_counts(c).withColumn("date", F.col("date").cast("string"))


@query(
    "risk_sequence",
    _PACK + f""", e AS (SELECT * FROM pack WHERE {_SEASON}), cal AS (SELECT DISTINCT date FROM e), ids AS (SELECT DISTINCT gid FROM e),
    c AS (SELECT ids.gid, cal.date, CASE WHEN e.gid IS NULL OR m.gid IS NOT NULL THEN '.' WHEN warn >= .5 THEN '2' WHEN warn >= .2 THEN '1' ELSE '0' END AS code FROM cal CROSS JOIN ids LEFT JOIN e ON e.gid = ids.gid AND e.date = cal.date LEFT JOIN masked m ON m.gid = ids.gid)
    SELECT gid, string_agg(code, '' ORDER BY date) AS codes FROM c GROUP BY 1""",
)
def risk_sequence(spark, d):
    return pk.risk_sequence(pack(spark, d), masked(spark, d))


@query("farm_series", _PACK + " SELECT CAST(date AS VARCHAR) AS date, p.gid, round(warn, 6) AS warn, stage, m.gid IS NOT NULL AS no_coverage FROM pack p LEFT JOIN masked m ON m.gid = p.gid WHERE date BETWEEN DATE '2024-05-15' AND DATE '2024-06-05'")
def farm_series(spark, d):
    s = pk.farm_series(pack(spark, d), masked(spark, d), F.lit("2024-05-15").cast("date"), F.lit("2024-06-05").cast("date"))
    return s.select(day(), "gid", r6("warn"), "stage", "no_coverage")


@query("season_info", _PACK + f" SELECT count(DISTINCT date) AS n_in_season_dates, CAST(max(date) AS VARCHAR) AS latest_in_season_date, false AS today_in_season FROM pack WHERE {_SEASON}")
def season_info(spark, d):
    s = pk.season_summary(pack(spark, d), F.lit("2024-07-15").cast("date"))
    return s.select("n_in_season_dates", day("latest_in_season_date"), "today_in_season")


@query("pack_lookup", _PACK + " SELECT CAST(date AS VARCHAR) AS date, gid, stage, round(warn, 6) AS warn FROM pack WHERE date = (SELECT max(date) FROM pack) AND len(adi7) > 0")
def pack_lookup(spark, d):
    return pk.pack_lookup(pack(spark, d)).select(day(), "gid", "stage", r6("warn"))


@query(
    "forecast_peak",
    _PACK + """, w AS (SELECT date, gid, list_transform(adi7, lambda a: CAST(round(least(1.0, greatest(0.0, a / 10)), 3) AS DOUBLE)) AS w FROM pack)
    SELECT CAST(date AS VARCHAR) AS date, gid, w[1] AS current_wbi, CAST(len(w) AS INT) AS horizon_days, list_max(w) AS peak_wbi, CAST(list_position(w, list_max(w)) AS BIGINT) AS peak_day FROM w""",
)
def forecast_peak(spark, d):
    return pk.forecast_peak(pack(spark, d)).select(day(), "gid", "current_wbi", "horizon_days", "peak_wbi", "peak_day")
