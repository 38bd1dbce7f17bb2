"""SQL names for the scalar library, so the same semantics are available in ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import fixed_values as fx
from .geo import EARTH_KM

SQL_FUNCTIONS = {
    "tw_guarded_ratio": ("n DOUBLE, d DOUBLE", "DOUBLE", "CASE WHEN d > 0 THEN n / d END"),
    "tw_sum_present": (
        "a DOUBLE, b DOUBLE", "DOUBLE",
        "CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN coalesce(a, 0D) + coalesce(b, 0D) END",
    ),
    "tw_falsy_coalesce": ("a DOUBLE, b DOUBLE, otherwise DOUBLE", "DOUBLE", "coalesce(nullif(a, 0D), nullif(b, 0D), otherwise)"),
    "tw_within": ("x DOUBLE, lo DOUBLE, hi DOUBLE", "DOUBLE", "CASE WHEN x > lo AND x < hi THEN x END"),
    "tw_round_half_up": ("x DOUBLE, digits INT", "DOUBLE", "sign(x) * floor(round(abs(x), 10) * pow(10, digits) + 0.5) / pow(10, digits)"),
    "tw_wind_sin": ("degrees DOUBLE", "DOUBLE", "sin(radians(degrees))"),
    "tw_wind_cos": ("degrees DOUBLE", "DOUBLE", "cos(radians(degrees))"),
    "tw_month_sin": ("d DATE", "DOUBLE", "sin((month(d) - 1) * 2D * pi() / 12D)"),
    "tw_month_cos": ("d DATE", "DOUBLE", "cos((month(d) - 1) * 2D * pi() / 12D)"),
    "tw_squared_degrees": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE", "(lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2)",
    ),
    "tw_great_circle_km": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
        f"{2.0 * EARTH_KM}D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) "
        "+ cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    ),
    "tw_season_id": ("d DATE", "INT", "CASE WHEN month(d) >= 11 THEN year(d) ELSE year(d) - 1 END"),
    "tw_season_name": (
        "d DATE", "STRING", "CASE WHEN month(d) >= 11 THEN concat(year(d), '-', year(d) + 1) ELSE concat(year(d) - 1, '-', year(d)) END",
    ),
    "tw_sst_weight": (
        "day_mean DOUBLE", "DOUBLE",
        f"CASE WHEN coalesce(day_mean, {fx.DEFAULT_DAY_SST}D) >= 15 THEN 1.5D WHEN coalesce(day_mean, {fx.DEFAULT_DAY_SST}D) >= 10 THEN 1D ELSE 0.7D END",
    ),
    "tw_severity_band": (
        "s DOUBLE", "STRING",
        "CASE WHEN s >= 0.8 THEN 'DANGER' WHEN s >= 0.6 THEN 'WARNING' WHEN s >= 0.3 THEN 'CAUTION' WHEN s IS NOT NULL THEN 'NORMAL' END",
    ),
    "tw_nutrient_status": (
        "x DOUBLE, danger DOUBLE, caution DOUBLE", "STRING", "CASE WHEN x < danger THEN 'DANGER' WHEN x < caution THEN 'CAUTION' ELSE 'NORMAL' END",
    ),
    "tw_risk_din_only": ("din DOUBLE", "DOUBLE", "CASE WHEN din = 0 THEN 0.5D ELSE greatest(0D, least(1D, 1 - din / 20)) END"),
    "tw_clamp": ("x DOUBLE, lo DOUBLE, hi DOUBLE", "DOUBLE", "greatest(lo, least(hi, x))"),
    "tw_in_season": ("d DATE", "BOOLEAN", "month(d) NOT IN (6, 7, 8, 9, 10)"),
    "tw_risk_stage": (
        "s DOUBLE", "INT",
        "CASE WHEN s >= 0.8 THEN 4 WHEN s >= 0.6 THEN 3 WHEN s >= 0.4 THEN 2 WHEN s >= 0.2 THEN 1 ELSE 0 END",
    ),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions and return their names."""
    for name, (args, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    return sorted(SQL_FUNCTIONS)
