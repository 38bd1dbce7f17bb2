"""Outlier flags, their roll-up and feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions.numeric import falsy_coalesce, guarded_ratio, lookup, round_half_up
from ..plans.frames import HOT_ROWS, framed

_SEVERITY = {"info": 1, "warning": 2, "critical": 3}


def _flag(kind: str, severity: Column, threshold: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("anomaly_type"), severity.alias("severity"), threshold.cast("double").alias("threshold")
    )


def bounds_flag(field: Column, value: Column) -> Column:
    """Struct when the value leaves the field's physical range, else NULL."""
    low = lookup(field, {k: v[0] for k, v in fx.PHYSICAL_BOUNDS.items()})
    high = lookup(field, {k: v[1] for k, v in fx.PHYSICAL_BOUNDS.items()})
    hit = F.when(value > high, high).when(value < low, low)
    return F.when(hit.isNotNull(), _flag("physical_range", F.lit("critical"), hit))


def domain_flag(field: Column, value: Column) -> Column:
    """Struct when the value crosses the field's caution or danger level, else NULL."""
    caution = lookup(field, {k: v[0] for k, v in fx.DOMAIN_THRESHOLDS.items()})
    danger = lookup(field, {k: v[1] for k, v in fx.DOMAIN_THRESHOLDS.items()})
    sign = lookup(field, {k: (-1.0 if v[2] == "low" else 1.0) for k, v in fx.DOMAIN_THRESHOLDS.items()})
    beyond = lambda level: sign * value >= sign * level
    return F.when(beyond(danger), _flag("domain_rule", F.lit("critical"), danger)).when(
        beyond(caution), _flag("domain_rule", F.lit("warning"), caution)
    )


def window_statistics(
    df: DataFrame,
    keys: list[str],
    order: list[tuple[str, bool]],
    value: str = "value",
    window: int = 50,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Mean, deviation, quartiles and count of the previous ``window`` rows, plus the previous value."""

    def measure(part: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*[F.col(c) if asc else F.col(c).desc() for c, asc in order])
        past = w.rowsBetween(-window, -1)
        return part.withColumns(
            {
                "win_n": F.count(value).over(past),
                "win_mean": F.avg(value).over(past),
                "win_std": F.stddev_pop(value).over(past),
                "win_q": F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).over(past),
                "prev_value": F.lag(value).over(w),
            }
        )

    return framed(df, keys, order, measure, preceding=window, hot_rows=hot_rows)


def statistic_flags(z_threshold: float = 3.0, iqr_factor: float = 1.5, spike_factor: float = 3.0, value: str = "value") -> dict[str, Column]:
    """z-score, interquartile and spike flags over the columns of ``window_statistics``."""
    x = F.col(value)
    enough = F.col("win_n") >= 10
    z = F.when(enough & (F.col("win_std") > 1e-6), F.abs(x - F.col("win_mean")) / F.col("win_std"))
    z_flag = F.when(
        z > z_threshold,
        _flag("z_score", F.when(z > z_threshold * 1.5, "critical").otherwise("warning"), F.lit(z_threshold)),
    )
    q1, q3 = F.col("win_q")[0], F.col("win_q")[1]
    spread = (q3 - q1) * iqr_factor
    outside = enough & ((x < q1 - spread) | (x > q3 + spread))
    iqr_flag = F.when(outside & z_flag.isNull(), _flag("iqr", F.lit("warning"), F.lit(None)))
    jump = F.when(F.abs("prev_value") > 1e-6, F.abs(x - F.col("prev_value")) / F.abs("prev_value"))
    spike = F.when(jump > spike_factor, _flag("spike", F.lit("warning"), F.lit(spike_factor)))
    return {"z_score": z_flag, "iqr": iqr_flag, "spike": spike}


def flag_outliers(
    readings: DataFrame,
    keys: list[str],
    order: list[tuple[str, bool]],
    window: int = 50,
    hot_rows: int = HOT_ROWS,
    **thresholds: float,
) -> DataFrame:
    """One row per raised flag, in the order bounds, z-score, IQR, spike, domain rule.

    ``readings`` has ``field`` and ``value``; flagged values still enter later windows.
    """
    present = readings.filter(F.col("value").isNotNull())
    return raised_flags(window_statistics(present, keys, order, window=window, hot_rows=hot_rows), **thresholds)


def raised_flags(stats: DataFrame, **thresholds: float) -> DataFrame:
    """One row per flag from readings with the columns of ``window_statistics``, which are dropped."""
    by_window = statistic_flags(**thresholds)
    flags = F.array_compact(
        F.array(
            bounds_flag(F.col("field"), F.col("value")),
            by_window["z_score"],
            by_window["iqr"],
            by_window["spike"],
            domain_flag(F.col("field"), F.col("value")),
        )
    )
    return (
        stats.withColumn("_flags", flags)
        .drop("win_n", "win_mean", "win_std", "win_q", "prev_value")
        .select("*", F.posexplode("_flags").alias("flag_no", "_flag"))
        .select("*", "_flag.*")
        .drop("_flag", "_flags")
    )


def replay_outliers(readings: DataFrame, keys: list[str], order: list[str], window: int = 50, **thresholds: float) -> DataFrame:
    """The flags of ``flag_outliers`` from an ordered replay of each key, as a stream of its readings would raise them.

    A key's readings are held by one task, so this is for checking a detector against its history; ``flag_outliers`` splits large keys.
    """
    from ..streaming.processors import WindowStatistics

    present = readings.filter(F.col("value").isNotNull())
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in present.schema)
    replay = WindowStatistics(["value"], order, window).replay
    # A reading costs far more than its bytes, so the session's number of tasks is kept
    dealt = present.repartition(int(present.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), *keys)
    stats = dealt.groupBy(*keys).applyInPandas(lambda rows: replay(rows), f"{columns}, {WindowStatistics.ADDED}")
    return raised_flags(stats, **thresholds)


def outlier_report(flags: DataFrame, record: list[str]) -> DataFrame:
    """Severity counts and worst severity per record."""
    rank = lookup(F.col("severity"), _SEVERITY)
    return flags.groupBy(*record).agg(
        F.count("*").alias("n_flags"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
        F.max_by("severity", rank).alias("max_severity"),
    )


def feature_projection(raw: DataFrame) -> DataFrame:
    """Feature columns from raw readings, where zero counts as missing."""
    c = lambda name: F.col(name) if name in raw.columns else F.lit(None).cast("double")
    nutrients = F.coalesce(c("no3_nitrogen"), F.lit(0.0)) + F.coalesce(c("nh4_nitrogen"), F.lit(0.0))
    staged = raw.withColumn("din", F.coalesce(F.nullif(c("din"), F.lit(0.0)), nutrients)).withColumn(
        "dip", falsy_coalesce(c("dip"), c("dip_surface"), default=20.0)
    )
    return staged.withColumns(
        {
            "din_dip_ratio": F.coalesce(round_half_up(guarded_ratio(F.col("din"), F.col("dip")), 4), F.lit(0.0)),
            "water_temp_surface": falsy_coalesce(c("water_temp"), c("water_temp_surface")),
            "do_surface": falsy_coalesce(c("dissolved_oxygen"), c("do_surface")),
            "chlorophyll_a": falsy_coalesce(c("chlorophyll_a"), c("chl_a"), c("chlorophyll")),
            "precipitation_3d": falsy_coalesce(c("precipitation"), c("precipitation_3d"), default=0.0),
        }
    )


def quality_flag(max_severity: Column) -> Column:
    """-1 for a critical record, 0 for a warning, 1 otherwise."""
    return F.when(max_severity == "critical", -1).when(max_severity == "warning", 0).otherwise(1)


def channel_health(long: DataFrame, channel: str = "channel", value: str = "value") -> DataFrame:
    """Spread, zero share and missing share per channel, with the dead-channel verdict."""
    v = F.col(value)
    return (
        long.groupBy(channel)
        .agg(
            F.avg(v).alias("mean"),
            F.stddev_pop(v).alias("std"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            (F.count_if(v == 0) * 100.0 / F.count("*")).alias("zero_pct"),
            (F.count_if(v.isNull()) * 100.0 / F.count("*")).alias("null_pct"),
        )
        .withColumn("dead", F.coalesce((F.col("std") < 1e-6) | (F.col("zero_pct") > 90), F.lit(True)))
    )
