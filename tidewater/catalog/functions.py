"""The scalar library, several functions per projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions import numeric as nm
from ..functions import optics, risk, seasons
from ..functions import text as tx
from ..functions.numeric import round_half_up
from .base import cte, day, query, r6, table, view

_D = "CAST({} AS DOUBLE)"


@query(
    "fn_parse",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS as_double, strftime(ts, '%Y-%m-%d %H:%M') AS stamp, strftime(ts, '2024-%m-%d %H:00') AS yearless,
    CAST(make_date(year(ts), month(ts), 15) AS VARCHAR) AS fixed_15th, CASE event_id % 4 WHEN 0 THEN 22.5::DOUBLE WHEN 1 THEN 0.0 WHEN 2 THEN 135.0 END AS wind FROM events""",
)
def fn_parse(spark, d):
    e = table(spark, d, "events").selectExpr(
        "event_id", "ts", "CASE WHEN event_type = 'error' THEN 'bad' ELSE CAST(value AS STRING) END AS raw",
        "CASE event_id % 2 WHEN 0 THEN date_format(ts, 'yyyy-MM-dd HH:mm') ELSE date_format(ts, 'yyyyMMddHHmm') END AS stamp_text",
        "date_format(ts, \"MM-dd HH'시'\") AS dam_text", "element_at(array('NNE', '북', '135', '??'), CAST(event_id % 4 + 1 AS INT)) AS wind_text",
    )
    fmt = "yyyy-MM-dd HH:mm"
    return e.select(
        "event_id", nm.to_double(F.col("raw")).alias("as_double"),
        F.date_format(nm.first_timestamp(F.col("stamp_text"), [fmt, "yyyyMMddHHmm"]), fmt).alias("stamp"),
        F.date_format(nm.yearless_timestamp(F.col("dam_text"), F.lit(2024)), fmt).alias("yearless"),
        F.make_date(F.year("ts"), F.month("ts"), F.lit(15)).cast("string").alias("fixed_15th"),
        nm.wind_degrees(F.col("wind_text")).alias("wind"),
    )


@query(
    "fn_calendar",
    """SELECT o_orderkey, month(o_orderdate) NOT IN (6, 7, 8, 9, 10) AS in_season, CAST(CASE WHEN month(o_orderdate) >= 11 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS INT) AS season,
    CASE WHEN month(o_orderdate) >= 11 THEN CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(year(o_orderdate) + 1 AS VARCHAR) ELSE CAST(year(o_orderdate) - 1 AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) END AS season_name,
    (SELECT string_agg(CAST(CAST(m AS DATE) + 14 AS VARCHAR), ',' ORDER BY m) FROM unnest(generate_series(date_trunc('month', o_orderdate), date_trunc('month', o_orderdate) + INTERVAL 5 MONTHS, INTERVAL 1 MONTH)) t(m) WHERE month(m) NOT IN (6, 7, 8, 9, 10)) AS mid_months,
    7 AS n_steps FROM orders""",
)
def fn_calendar(spark, d):
    o = table(spark, d, "orders").withColumn("date", F.col("o_orderdate").cast("date"))
    date = F.col("date")
    joined = F.array_join(seasons.season_mid_months(date, F.add_months(date, 5)).cast("array<string>"), ",")
    return o.select(
        "o_orderkey", seasons.in_season(date).alias("in_season"), seasons.season_id(date).alias("season"),
        seasons.season_name(date).alias("season_name"), F.when(joined != "", joined).alias("mid_months"),
        F.size(seasons.every_k_days(date, F.date_add(date, 30), 5)).alias("n_steps"),
    )


@query(
    "fn_trig",
    """SELECT event_id, round(sin(radians(value)), 6) + 0.0 AS wind_sin, round(cos(radians(value)), 6) + 0.0 AS wind_cos, round(sin((month(ts) - 1) * 2 * pi() / 12), 6) + 0.0 AS month_sin,
    round(cos((month(ts) - 1) * 2 * pi() / 12), 6) + 0.0 AS month_cos, round(sqrt(value * value + user_id * user_id), 6) AS speed FROM events""",
)
def fn_trig(spark, d):
    sin, cos = nm.wind_vector(F.col("value"))
    msin, mcos = nm.month_cycle(F.col("ts"))
    return table(spark, d, "events").select(
        "event_id", r6(sin, "wind_sin"), r6(cos, "wind_cos"), r6(msin, "month_sin"), r6(mcos, "month_cos"), r6(F.hypot("value", "user_id"), "speed")
    )


@query(
    "fn_null_math",
    cte("v_station_obs") + """SELECT l_orderkey, l_linenumber, l_partkey, station_id, round(CASE WHEN dip_ugl > 5 THEN din_ugl / (dip_ugl - 5) END, 6) AS ratio,
    round(CASE WHEN water_temp IS NOT NULL OR nullif(salinity, 28.0) IS NOT NULL THEN coalesce(water_temp, 0) + coalesce(nullif(salinity, 28.0), 0) END, 6) AS total,
    round(CASE WHEN water_temp IS NOT NULL THEN greatest(10.0, least(25.0, water_temp)) END, 6) AS clamped FROM v_station_obs""",
)
def fn_null_math(spark, d):
    o = view(spark, d, "v_station_obs")
    return o.select(
        "l_orderkey", "l_linenumber", "l_partkey", "station_id",
        r6(nm.guarded_ratio(F.col("din_ugl"), F.col("dip_ugl") - 5), "ratio"),
        r6(nm.sum_present(F.col("water_temp"), F.nullif(F.col("salinity"), F.lit(28.0))), "total"),
        r6(nm.clamp(F.col("water_temp"), 10.0, 25.0), "clamped"),
    )


@query(
    "fn_buckets",
    cte("v_scores") + """SELECT pred_id, CAST(CASE WHEN warn >= .8 THEN 4 WHEN warn >= .6 THEN 3 WHEN warn >= .4 THEN 2 WHEN warn >= .2 THEN 1 ELSE 0 END AS INT) AS stage,
    CASE WHEN warn >= .8 THEN 'DANGER' WHEN warn >= .6 THEN 'WARNING' WHEN warn >= .3 THEN 'CAUTION' ELSE 'NORMAL' END AS band,
    CASE WHEN warn >= .5 THEN 'sustained' WHEN warn >= .2 THEN 'watch' ELSE 'normal' END AS risk, CASE WHEN warn >= .5 THEN '2' WHEN warn >= .2 THEN '1' ELSE '0' END AS code,
    coalesce(CASE stage WHEN 0 THEN '정상' WHEN 1 THEN '초기' WHEN 2 THEN '경계' WHEN 3 THEN '심각' END, '??') AS label FROM v_scores""",
)
def fn_buckets(spark, d):
    w = F.col("warn")
    return view(spark, d, "v_scores").select(
        "pred_id", risk.risk_stage(w).alias("stage"), risk.severity_band(w).alias("band"), risk.warn_class(w).alias("risk"),
        nm.lookup(risk.warn_class(w), fx.RISK_CODES).alias("code"),
        F.coalesce(nm.lookup(F.col("stage"), fx.PACK_STAGE_LABELS), F.lit("??")).alias("label"),
    )


@query(
    "fn_arrays",
    """SELECT vec_id, round(CAST(list_max(embedding) AS DOUBLE), 6) AS top, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS top_index,
    round(exp(0.0) / list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: exp(x - list_max(CAST(embedding AS DOUBLE[]))))), 6) AS top_weight FROM embeddings""",
)
def fn_arrays(spark, d):
    e = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return e.select(
        "vec_id", r6(F.array_max("v"), "top"), nm.argmax(F.col("v")).alias("top_index"), r6(F.array_max(nm.softmax(F.col("v"))), "top_weight")
    )


@query(
    "threshold_status",
    cte("v_station_obs") + """SELECT l_orderkey, l_linenumber, l_partkey, station_id, feature, CASE WHEN v IS NULL THEN 'UNKNOWN' WHEN feature <> 'water_temp' AND v < thr THEN 'BELOW_THRESHOLD' WHEN feature <> 'water_temp' THEN 'ABOVE_THRESHOLD'
     WHEN v > thr THEN 'ABOVE_THRESHOLD' ELSE 'BELOW_THRESHOLD' END AS status FROM (
     SELECT *, unnest(['din', 'water_temp', 'salinity', 'dissolved_oxygen']) AS feature, unnest([din_ugl / 14.007, water_temp, salinity, dissolved_oxygen]) AS v, unnest([5.0, 25.0, 30.0, 5.0]) AS thr FROM v_station_obs)""",
)
def threshold_status(spark, d):
    o = view(spark, d, "v_station_obs").withColumn("din", F.col("din_ugl") / fx.N_ATOMIC)
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "station_id"]
    long = o.unpivot(ids, ["din", "water_temp", "salinity", "dissolved_oxygen"], "feature", "v")
    return long.select(*ids, "feature", nm.threshold_status(F.col("feature"), F.col("v"), fx.CAUSE_THRESHOLDS_5, fx.LOW_IS_RISK_5).alias("status"))


@query(
    "minmax_scale",
    cte("v_daily") + """SELECT CAST(date AS VARCHAR) AS date, cell_id, round(CASE WHEN max(sst) OVER w > min(sst) OVER w THEN (sst - min(sst) OVER w) / (max(sst) OVER w - min(sst) OVER w) ELSE 0.5 END, 6) AS scaled FROM v_daily WINDOW w AS (PARTITION BY cell_id)""",
)
def minmax_scale(spark, d):
    daily = view(spark, d, "v_daily")
    span = daily.groupBy("cell_id").agg(F.min("sst").alias("lo"), F.max("sst").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("sst") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    return daily.join(span, "cell_id").select(day("date"), "cell_id", r6(scaled, "scaled"))


@query(
    "feature_vector",
    cte("v_station_obs") + """SELECT l_orderkey, l_linenumber, l_partkey, station_id, round((coalesce(water_temp, 15) - 15) / 5, 6) AS f0, round((dissolved_oxygen - 8) / 2, 6) AS f1, round((din_ugl / 14.007 - 5) / 5, 6) AS f2,
    round((dip_ugl / 30.974 - 0.5) / CAST(0.3 AS DOUBLE), 6) AS f3, round((salinity - 32) / 2, 6) AS f5, 0.0::DOUBLE AS f6, 8 AS n FROM v_station_obs""",
)
def feature_vector(spark, d):
    o = view(spark, d, "v_station_obs").withColumns(
        {
            "din": F.col("din_ugl") / fx.N_ATOMIC, "dip": F.col("dip_ugl") / fx.P_ATOMIC, "np_ratio": F.lit(None).cast("double"),
            "precipitation": F.lit(None).cast("double"), "chlorophyll_a": F.lit(None).cast("double"),
        }
    )
    vector = F.array(*[nm.scaled_feature(name, F.col(name)) for name in fx.FEATURE_SCALING])
    out = o.withColumn("v", vector)
    picks = {f"f{i}": r6(F.col("v")[i], f"f{i}") for i in (0, 1, 2, 3, 5, 6)}
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "station_id", *picks.values(), F.size("v").alias("n"))


@query(
    "fn_strings",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '서천' WHEN 1 THEN '완도' WHEN 2 THEN '종로' ELSE '시' END AS region, chr(CAST(65 + c_nationkey AS INT)) AS letter, replace('SITE-' || c_name || '-' || c_mktsegment || ' A', ' ', '_') AS sensor_id,
    CASE WHEN c_acctbal > 0 THEN 'bal=' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) || ', ' ELSE '' END || 'seg=' || c_mktsegment AS summary, 'doc_' || CASE WHEN c_custkey < 1000 THEN lpad(CAST(c_custkey AS VARCHAR), 4, '0') ELSE CAST(c_custkey AS VARCHAR) END AS doc_id FROM customer""",
)
def fn_strings(spark, d):
    c = table(spark, d, "customer")
    name = F.element_at(F.array(*[F.lit(x) for x in ("충청남도 서천군", "전라남도 완도군", "서울 종로구", "어느 시")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    balance = F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal"))
    return c.select(
        "c_custkey", tx.short_region(name).alias("region"), tx.zone_letters(F.col("c_nationkey")).alias("letter"),
        tx.composite_id(F.lit("SITE"), F.col("c_name"), F.concat("c_mktsegment", F.lit(" A"))).alias("sensor_id"),
        tx.key_value_summary({"bal": balance, "seg": F.col("c_mktsegment")}).alias("summary"), tx.running_doc_id(F.col("c_custkey")).alias("doc_id"),
    )


@query(
    "fn_rounding",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_quantity / 4, 1) AS even_1, round(l_quantity / 4, 1) AS up_1, round_even(l_quantity / 2, 0) AS even_0 FROM lineitem",
)
def fn_rounding(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", nm.round_even(F.col("l_quantity") / 4, 1).alias("even_1"),
        round_half_up(F.col("l_quantity") / 4, 1).alias("up_1"), nm.round_even(F.col("l_quantity") / 2, 0).alias("even_0"),
    )


@query(
    "bitmask_clear",
    "SELECT event_id, (CAST(json_extract(props, '$.k') AS BIGINT) * 8 + user_id) AS flag FROM events WHERE ((CAST(json_extract(props, '$.k') AS BIGINT) * 8 + user_id) & 807) = 0",
)
def bitmask_clear(spark, d):
    e = table(spark, d, "events").withColumn("flag", F.get_json_object("props", "$.k").cast("bigint") * 8 + F.col("user_id"))
    return e.filter(optics.clear_pixel(F.col("flag"))).select("event_id", "flag")


_BANDS = "l_discount + CAST(0.004 AS DOUBLE) AS b443, l_tax + CAST(0.005 AS DOUBLE) AS b490, l_quantity / CAST(1000 AS DOUBLE) - CAST(0.002 AS DOUBLE) AS b555, l_quantity / CAST(5000 AS DOUBLE) AS b865"


@query(
    "oc3_chlorophyll",
    f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_BANDS} FROM lineitem), r AS (SELECT *, CASE WHEN b555 > 0 THEN log10(greatest(b443, b490) / b555) END AS r FROM b),
    c AS (SELECT *, pow(10.0, 0.2424 - 2.7423 * r + 1.8017 * r * r + 0.0015 * r * r * r - 1.2280 * r * r * r * r) AS chl FROM r)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN chl > 0 AND chl < 200 THEN chl END, 6) AS chl, round(CASE WHEN b555 > 0 THEN b865 / b555 END, 6) AS nir FROM c""",
)
def oc3(spark, d):
    b = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_BANDS.replace(", l_", "|l_").split("|"))
    chl = optics.oc3_chlorophyll(F.col("b443"), F.col("b490"), F.col("b555"))
    return b.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(chl, "chl"), r6(optics.nir_ratio(F.col("b865"), F.col("b555")), "nir"))


@query(
    "ndci",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(CAST(l_quantity * 10 - 10 AS BIGINT), 0) * CAST(1e-4 AS DOUBLE) AS r, nullif(CAST(floor(l_extendedprice) AS BIGINT) % 700, 0) * CAST(1e-4 AS DOUBLE) AS e, 5 + l_linenumber % 2 AS scl FROM lineitem),
    i AS (SELECT *, CASE WHEN e + r > 1e-6 THEN (e - r) / (e + r) END AS x FROM b) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN scl = 6 AND abs(x) <= 1 THEN x END, 6) AS ndci FROM i""",
)
def ndci(spark, d):
    b = table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CAST(round(l_quantity * 10 - 10) AS BIGINT) AS b04",
        "floor(l_extendedprice) % 700 AS b05", "5 + l_linenumber % 2 AS scl",
    )
    return b.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(optics.ndci(F.col("b04"), F.col("b05"), F.col("scl")), "ndci"))


@query("in_season", cte("v_daily") + "SELECT DISTINCT CAST(date AS VARCHAR) AS date, month(date) NOT IN (6, 7, 8, 9, 10) AS harvest, month(date) NOT IN (6, 7, 8) AS growing, month(date) NOT IN (5, 6, 7, 8, 9) AS clear_water FROM v_daily")
def in_season(spark, d):
    days = view(spark, d, "v_daily").select("date").distinct()
    date = F.col("date")
    return days.select(
        day("date"), seasons.in_season(date).alias("harvest"), seasons.in_season(date, fx.NO_GROWTH_MONTHS).alias("growing"),
        seasons.in_season(date, (5, 6, 7, 8, 9)).alias("clear_water"),
    )


@query("season_list", cte("v_daily") + "SELECT DISTINCT CASE WHEN month(date) >= 11 THEN CAST(year(date) AS VARCHAR) || '-' || CAST(year(date) + 1 AS VARCHAR) ELSE CAST(year(date) - 1 AS VARCHAR) || '-' || CAST(year(date) AS VARCHAR) END AS season FROM v_daily WHERE month(date) NOT IN (6, 7, 8, 9, 10)")
def season_list(spark, d):
    days = view(spark, d, "v_daily").filter(seasons.in_season(F.col("date")))
    return days.select(seasons.season_name(F.col("date")).alias("season")).distinct().orderBy("season")


@query(
    "unit_convert",
    cte("v_station_obs") + """SELECT l_orderkey, l_linenumber, l_partkey, station_id, round(din_ugl / 14.007, 2) AS din, round(dip_ugl / 30.974, 3) AS dip, round(round(din_ugl / 14.007, 2) / nullif(round(dip_ugl / 30.974, 3), 0), 2) AS np_ratio FROM v_station_obs""",
)
def unit_convert(spark, d):
    o = view(spark, d, "v_station_obs").withColumns(
        {"din": round_half_up(F.col("din_ugl") / fx.N_ATOMIC, 2), "dip": round_half_up(F.col("dip_ugl") / fx.P_ATOMIC, 3)}
    )
    return o.select(
        "l_orderkey", "l_linenumber", "l_partkey", "station_id", "din", "dip",
        round_half_up(F.col("din") / F.nullif(F.col("dip"), F.lit(0.0)), 2).alias("np_ratio"),
    )


@query("nutrient_status", cte("v_station_obs") + "SELECT l_orderkey, l_linenumber, l_partkey, station_id, CASE WHEN din_ugl < 70 THEN 'DANGER' WHEN din_ugl < 100 THEN 'CAUTION' ELSE 'NORMAL' END AS din_status, CASE WHEN dip_ugl < 6 THEN 'DANGER' WHEN dip_ugl < 16 THEN 'CAUTION' ELSE 'NORMAL' END AS dip_status FROM v_station_obs")
def nutrient_status(spark, d):
    return view(spark, d, "v_station_obs").select(
        "l_orderkey", "l_linenumber", "l_partkey", "station_id", risk.nutrient_status(F.col("din_ugl"), 70.0, 100.0).alias("din_status"),
        risk.nutrient_status(F.col("dip_ugl"), 6.0, 16.0).alias("dip_status"),
    )
