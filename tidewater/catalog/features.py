"""Risk index, causes, scenarios, snapshots and report texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions import risk
from ..operators import reports as rp
from ..functions.numeric import round_half_up
from .base import cte, query, r6, view

_ID = "l_orderkey, l_linenumber, l_partkey, station_id"
_IDS = _ID.split(", ")
_F = ", x AS (SELECT *, row_number() OVER () AS rid, din_ugl / CAST(14.007 AS DOUBLE) AS din, dip_ugl / CAST(30.974 AS DOUBLE) AS dip, coalesce(din_ugl / CAST(14.007 AS DOUBLE) / nullif(dip_ugl / CAST(30.974 AS DOUBLE), 0), 16) AS np_ratio FROM v_station_obs)"


def _score(din="din", wt="coalesce(water_temp, 15)", nr="np_ratio", do="dissolved_oxygen", sal="salinity"):
    return (
        f"least(1.0, greatest(0.0, 0.38 * greatest(0.0, 1 - {din} / 5) + 0.27 * greatest(0.0, ({wt} - 20) / 10) + 0.19 * greatest(0.0, 1 - {nr} / 10) "
        f"+ 0.10 * greatest(0.0, 1 - {do} / 5) + 0.06 * greatest(0.0, (32 - {sal}) / 4)))"
    )


def factors(spark, d):
    """Observations in micromolar units with the N:P ratio."""
    return view(spark, d, "v_station_obs").withColumns(
        {"din": F.col("din_ugl") / fx.N_ATOMIC, "dip": F.col("dip_ugl") / fx.P_ATOMIC}
    ).withColumn("np_ratio", F.coalesce(F.col("din") / F.nullif(F.col("dip"), F.lit(0.0)), F.lit(16.0)))


def _cols():
    return [F.col(c) for c in rp.FACTORS]


@query("risk_index_molar", cte("v_station_obs") + _F + f" SELECT {_ID}, round({_score()}, 6) AS score FROM x")
def risk_index_molar(spark, d):
    return factors(spark, d).select(*_IDS, r6(risk.risk_index_molar(*_cols()), "score"))


@query(
    "risk_index_mass",
    cte("v_station_obs") + f"""SELECT {_ID}, CASE WHEN v - floor(v) = 0.5 THEN floor(v) + floor(v) % 2 ELSE floor(v + 0.5) END / CAST(10000 AS DOUBLE) AS score FROM (SELECT {_ID}, CAST(least(1.0, greatest(0.0, 0.38 * greatest(0.0, 1 - coalesce(nullif(din_ugl, 0), 100) / 70) + 0.27 * greatest(0.0, (coalesce(nullif(water_temp, 0), 15) - 20) / 10)
    + 0.19 * greatest(0.0, 1 - coalesce(nullif(round(din_ugl / dip_ugl, 4), 0), 26) / 6) + 0.10 * greatest(0.0, 1 - dissolved_oxygen / 5) + 0.06 * greatest(0.0, (32 - salinity) / 4))) AS DECIMAL(32, 10)) * 10000 AS v FROM v_station_obs)""",
)
def risk_index_mass(spark, d):
    o = view(spark, d, "v_station_obs")
    ratio = round_half_up(F.col("din_ugl") / F.col("dip_ugl"), 4)
    return o.select(
        *_IDS, risk.risk_index_mass(F.col("din_ugl"), F.col("water_temp"), ratio, F.col("dissolved_oxygen"), F.col("salinity")).alias("score")
    )


@query(
    "risk_index_grid",
    cte("v_station_obs") + _F + f""" SELECT {_ID}, round(least(1.0, greatest(0.0, 0.38 * least(1.0, greatest(0.0, 1 - din / 5)) + 0.27 * least(1.0, greatest(0.0, (water_temp - 20) / 10)) + 0.19 * least(1.0, greatest(0.0, 1 - np_ratio / 10))
    + 0.10 * least(1.0, greatest(0.0, 1 - dissolved_oxygen / 5)) + 0.06 * least(1.0, greatest(0.0, (32 - salinity) / 4)))), 6) AS score,
    round(CASE WHEN din = 0 THEN 0.5 ELSE least(1.0, greatest(0.0, 1 - din / 20)) END, 6) AS din_only FROM x""",
)
def risk_index_grid(spark, d):
    x = factors(spark, d)
    return x.select(*_IDS, r6(risk.risk_index_grid(*_cols()), "score"), r6(risk.risk_index_din_only(F.col("din")), "din_only"))


@query(
    "risk_stage",
    cte("v_station_obs") + _F + f", s AS (SELECT {_score()} AS score FROM x) SELECT CAST(CASE WHEN score >= 0.8 THEN 4 WHEN score >= 0.6 THEN 3 WHEN score >= 0.4 THEN 2 WHEN score >= 0.2 THEN 1 ELSE 0 END AS INT) AS stage, count(*) AS n FROM s GROUP BY 1",
)
def risk_stage(spark, d):
    return factors(spark, d).select(risk.risk_stage(risk.risk_index_molar(*_cols())).alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


@query(
    "risk_contributions",
    cte("v_station_obs") + _F + f""" SELECT {_ID}, factor, round(pct, 6) AS pct, row_number() OVER (PARTITION BY rid ORDER BY round(pct, 6) DESC, factor) AS rank FROM (SELECT *, unnest(['din', 'water_temp', 'np_ratio', 'dissolved_oxygen', 'salinity']) AS factor,
    unnest([0.38 * greatest(0.0, 1 - din / 5) * 100, 0.27 * greatest(0.0, (water_temp - 20) / 10) * 100, 0.19 * greatest(0.0, 1 - np_ratio / 10) * 100, 0.10 * greatest(0.0, 1 - dissolved_oxygen / 5) * 100, 0.06 * greatest(0.0, (32 - salinity) / 4) * 100]) AS pct FROM x)""",
)
def risk_contributions(spark, d):
    """Each row's five shares are ranked inside the row, before they are unnested."""
    x = factors(spark, d)
    parts = risk.risk_parts(*_cols())
    entries = F.array(
        *[
            F.struct((-round_half_up(F.lit(fx.RISK_WEIGHTS[f]) * parts[f] * 100.0, 6)).alias("neg"), F.lit(f).alias("factor"))
            for f in rp.FACTORS
        ]
    )
    ranked = x.select(*_IDS, F.posexplode(F.array_sort(entries)).alias("p", "e"))
    return ranked.select(*_IDS, F.col("e.factor").alias("factor"), (-F.col("e.neg") + 0.0).alias("pct"), (F.col("p") + 1).cast("bigint").alias("rank"))


_STATION_MEAN = """, m AS (SELECT station_id, avg(din) AS din, avg(dip) AS dip, avg(water_temp) AS water_temp, avg(dissolved_oxygen) AS dissolved_oxygen, avg(salinity) AS salinity FROM x GROUP BY 1)"""


def station_means(spark, d):
    return factors(spark, d).groupBy("station_id").agg(
        *[F.avg(c).alias(c) for c in ("din", "dip", "water_temp", "dissolved_oxygen", "salinity")]
    )


@query(
    "sensitivity_sweep",
    cte("v_station_obs") + _F + _STATION_MEAN + f""", w AS (SELECT m.*, CAST(step AS INT) AS step, i.step / 60.0 * 15.0 AS x FROM m CROSS JOIN (SELECT unnest(range(61)) AS step) i)
    SELECT station_id, step, round(x, 6) AS x, round({_score('x', 'water_temp', 'CASE WHEN dip > 0 THEN x / dip ELSE 0 END')}, 6) AS score, row_number() OVER (PARTITION BY station_id ORDER BY round(abs(x - din), 9), step) = 1 AS is_current FROM w""",
)
def sensitivity_sweep(spark, d):
    return rp.sensitivity_sweep(station_means(spark, d), "din").select("station_id", "step", r6("x"), r6("score"), "is_current")


@query(
    "scenario_scores",
    cte("v_station_obs") + _F + _STATION_MEAN + f""", p(scenario, wt, dn, dp, sl, dox) AS (VALUES ('정상', 18.0, 9.0, 0.6, 33.0, 9.0), ('주의', 23.0, 4.5, 0.5, 32.0, 7.0), ('경고', 26.0, 2.5, 0.5, 30.5, 5.5), ('위험', 29.5, 0.8, 0.45, 28.5, 3.5))
    SELECT station_id, scenario, round({_score('din', 'water_temp', 'CASE WHEN dip > 0 THEN din / dip ELSE 0 END')}, 6) AS current_score, round({_score('dn', 'wt', 'CAST(dn AS DOUBLE) / CAST(dp AS DOUBLE)', 'dox', 'sl')}, 6) AS score FROM m CROSS JOIN p""",
)
def scenario_scores(spark, d):
    return rp.scenario_scores(station_means(spark, d), ["station_id"]).select("station_id", "scenario", r6("current_score"), r6("score"))


@query(
    "top_causes",
    cte("v_station_obs") + _F + f""", e AS (SELECT {_ID}, rid, unnest(['water_temp', 'dissolved_oxygen', 'din', 'dip', 'np_ratio', 'salinity']) AS feature, unnest([0, 1, 2, 3, 4, 5]) AS i,
      unnest([water_temp, dissolved_oxygen, din, dip, np_ratio, salinity]) AS v, unnest([25.0, 5.0, 5.0, 0.3, 16.0, 30.0]) AS thr,
      unnest([water_temp / 40, dissolved_oxygen / 20, din / 30, dip, np_ratio / 50, salinity / 60]) AS w FROM x),
    r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY w DESC, i) AS rank FROM e)
    SELECT {_ID}, CAST(rank AS INT) AS rank, feature, round(w, 4) AS importance, CASE WHEN feature IN ('din', 'dissolved_oxygen', 'salinity') THEN CASE WHEN v < thr THEN 'BELOW_THRESHOLD' ELSE 'ABOVE_THRESHOLD' END
      WHEN v > thr THEN 'ABOVE_THRESHOLD' ELSE 'BELOW_THRESHOLD' END AS status FROM r WHERE rank <= 5""",
)
def top_causes(spark, d):
    return _causes(spark, d).select(*_IDS, "rank", "feature", round_half_up(F.col("importance"), 4).alias("importance"), "status")


def _causes(spark, d):
    x = factors(spark, d)
    weights = {
        "water_temp": F.col("water_temp") / 40, "dissolved_oxygen": F.col("dissolved_oxygen") / 20, "din": F.col("din") / 30,
        "dip": F.col("dip"), "np_ratio": F.col("np_ratio") / 50, "salinity": F.col("salinity") / 60,
    }
    return rp.top_causes(x, _IDS, weights, fx.CAUSE_THRESHOLDS_8, fx.LOW_IS_RISK_8)


_ADVICE = ", ".join(f"('{f}', '{s}', '{t}')" for f, s, t in fx.CAUSE_ADVICE)
_STAGES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in fx.STAGE_DESCRIPTIONS.items())
_ACTIONS = " || ".join(f"CASE WHEN stage >= {lv} THEN '{t} | ' ELSE '' END" for lv, t in fx.STAGE_ACTIONS)
_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fx.FEATURE_DISPLAY.items())


@query(
    "report_templates",
    cte("v_station_obs") + _F + _STATION_MEAN + f""", s AS (SELECT *, round({_score('din', 'water_temp', 'din / dip')}, 3) AS score FROM m),
    st AS (SELECT *, CASE WHEN score >= 0.8 THEN 4 WHEN score >= 0.6 THEN 3 WHEN score >= 0.4 THEN 2 WHEN score >= 0.2 THEN 1 ELSE 0 END AS stage FROM s),
    e AS (SELECT station_id, unnest(['din', 'water_temp', 'np_ratio', 'dissolved_oxygen', 'salinity']) AS feature, unnest([1, 2, 3, 4, 5]) AS rank, unnest([din, water_temp, din / dip, dissolved_oxygen, salinity]) AS v, unnest([5.0, 25.0, 10.0, 5.0, 30.0]) AS thr FROM st),
    c AS (SELECT station_id, feature, rank, CASE WHEN feature <> 'water_temp' THEN CASE WHEN v < thr THEN 'BELOW_THRESHOLD' ELSE 'ABOVE_THRESHOLD' END WHEN v > thr THEN 'ABOVE_THRESHOLD' ELSE 'BELOW_THRESHOLD' END AS status FROM e),
    a(feature, status, advice) AS (VALUES {_ADVICE}), g AS (SELECT station_id, string_agg(advice, ' | ' ORDER BY rank) FILTER (WHERE rank <= 3) AS adv, arg_min(feature, rank) AS top FROM c LEFT JOIN a USING (feature, status) GROUP BY 1)
    SELECT station_id, CAST(stage AS INT) AS stage, (CASE stage {_STAGES} END) || ' 황백화 지수: ' || CAST(CAST(CAST(score * 100 AS DECIMAL(28, 10)) AS DECIMAL(18, 1)) AS VARCHAR) || '%. 주요 원인 변수는 ''' || (CASE top {_NAMES} END) || '''입니다.' AS summary, {_ACTIONS} || adv AS recommendations FROM st JOIN g USING (station_id)""",
)
def report_templates(spark, d):
    means = station_means(spark, d).withColumn("np_ratio", F.col("din") / F.col("dip"))
    scored = means.withColumn("score", round_half_up(risk.risk_index_molar(*_cols()), 3)).withColumn("stage", risk.risk_stage(F.col("score")))
    weights = {f: F.lit(w) for f, w in fx.RISK_WEIGHTS.items()}
    causes = rp.top_causes(scored, ["station_id"], weights, fx.CAUSE_THRESHOLDS_5, fx.LOW_IS_RISK_5)
    return rp.report_templates(scored.select("station_id", "stage", "score"), causes, "station_id")


@query(
    "farm_snapshot",
    cte("v_station_obs") + f"""SELECT {_ID}, round(coalesce(water_temp, 15), 2) AS water_temp, round(dissolved_oxygen, 2) AS dissolved_oxygen, round(din_ugl, 2) AS din, round(greatest(dip_ugl - 1, 1e-6), 3) AS dip,
    round(din_ugl / greatest(dip_ugl - 1, 1e-6), 2) AS np_ratio, round(salinity, 2) AS salinity FROM v_station_obs""",
)
def farm_snapshot(spark, d):
    o = view(spark, d, "v_station_obs").withColumnsRenamed({"water_temp": "sst"}).withColumns(
        {"din": F.col("din_ugl"), "dip": F.col("dip_ugl") - 1}
    )
    return rp.farm_snapshot(o).select(*_IDS, "water_temp", "dissolved_oxygen", "din", "dip", "np_ratio", "salinity")


@query(
    "alert_feed",
    cte("v_scores") + """, n AS (SELECT * FROM (SELECT s.*, e.ts, row_number() OVER (ORDER BY e.ts DESC, pred_id DESC) AS rn FROM v_scores s JOIN events e ON e.event_id = s.pred_id) WHERE rn <= 60),
    a AS (SELECT *, row_number() OVER (ORDER BY ts DESC, pred_id DESC) - 1 AS alert_no FROM n WHERE warn >= 0.3)
    SELECT pred_id, alert_no, CASE WHEN warn >= .8 THEN 'DANGER' WHEN warn >= .6 THEN 'WARNING' ELSE 'CAUTION' END AS severity, CASE WHEN warn > 0.6 OR latency_ms > 25 OR latency_ms / 10 < 5 THEN
      concat_ws(' | ', CASE WHEN latency_ms / 10 < 5 THEN 'DIN ' || CAST(CAST(CAST(latency_ms / 10 AS DECIMAL(28, 10)) AS DECIMAL(18, 1)) AS VARCHAR) || ' μmol/L (임계값 이하)' END, CASE WHEN latency_ms > 25 THEN '수온 ' || CAST(CAST(CAST(latency_ms AS DECIMAL(28, 10)) AS DECIMAL(18, 1)) AS VARCHAR) || '℃ (25℃ 초과)' END, CASE WHEN warn > 0.6 THEN 'WBI ' || CAST(CAST(CAST(warn * 100 AS DECIMAL(28, 10)) AS DECIMAL(18, 0)) AS VARCHAR) || '%' END)
      ELSE '황백화 ' || CASE WHEN warn >= .8 THEN 'DANGER' WHEN warn >= .6 THEN 'WARNING' ELSE 'CAUTION' END END AS message FROM a WHERE alert_no < 20""",
)
def alert_feed(spark, d):
    from .base import table

    e = table(spark, d, "events").select(
        F.col("event_id").alias("pred_id"), "ts", F.col("value").alias("latency_ms"), (F.col("value") / (F.col("value") + 30.0)).alias("warn")
    )
    e = e.withColumn("severity", risk.severity_band(F.col("warn")))
    feed = rp.alert_feed(e, ["ts", "pred_id"], "severity")
    return feed.select(
        "pred_id", F.col("alert_no").cast("bigint").alias("alert_no"), "severity",
        rp.alert_message(F.col("latency_ms") / 10, F.col("latency_ms"), F.col("warn")).alias("message"),
    )
