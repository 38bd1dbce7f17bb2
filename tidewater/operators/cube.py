"""Channel cube, normalisation statistics and cube merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions.numeric import guarded_ratio, month_cycle, round_half_up, sum_present, wind_vector
from ..plans.frames import staged
from ..plans.ordering import exact_quantiles, join_null_safe
from .interpolation import Grid, interpolate_spans
from .labels import adi_labels
from .spatial import spatial_gradient
from .temporal import days_since_rain, first_in_window_spans, forward_fill, mean_fill, rolling_means

# Raw channel -> (measure, source ranks that may feed it, tolerance in days). Rank 0 = coastal survey,
# 1 = monitoring network, 2 = weather, 3 = ocean model, 4 = satellite.
RAW_CHANNELS = {
    "sst": ("water_temp", (0, 1), 90),
    "dip": ("dip", (1,), 90),
    "sio2": ("sio2", (1,), 90),
    "salinity": ("salinity", (0, 1), 90),
    "precipitation": ("precipitation_mm", (2,), 1),
    "solar_radiation": ("solar_radiation_mjm2", (2,), 1),
    "chlorophyll_a": ("chlorophyll_a", (1,), 90),
    "dissolved_oxygen": ("dissolved_oxygen", (0, 1), 90),
    "current_u": ("current_u", (3,), 7),
    "current_v": ("current_v", (3,), 7),
    "turbidity": ("turbidity", (1,), 90),
    "wind_speed": ("avg_wind_speed", (2,), 1),
    "wind_dir_sin": ("wind_dir_sin", (2,), 1),
    "wind_dir_cos": ("wind_dir_cos", (2,), 1),
    "air_temp": ("avg_temp", (2,), 1),
    "ph": ("ph", (1,), 90),
    "no3_nitrogen": ("no3_nitrogen", (1,), 90),
    "nh4_nitrogen": ("nh4_nitrogen", (1,), 90),
    "nir_idx": ("nir_idx", (4,), 1),
    "mld": ("mld", (3,), 7),
}


def with_wind_vector(measures: DataFrame) -> DataFrame:
    """Replace wind direction by its sine and cosine in the long table."""
    sin, cos = wind_vector(F.col("value"))
    entry = lambda name, value: F.struct(name.alias("measure"), value.alias("value"))
    parts = F.when(
        F.col("measure") == "wind_dir_deg",
        F.array(entry(F.lit("wind_dir_sin"), sin), entry(F.lit("wind_dir_cos"), cos)),
    ).otherwise(F.array(entry(F.col("measure"), F.col("value"))))
    rest = [c for c in measures.columns if c not in ("measure", "value")]
    return measures.select(*rest, F.inline(parts))


def channel_spans(measures: DataFrame, channels: dict = RAW_CHANNELS) -> DataFrame:
    """The days on which each reading is the one of its channel, location and source, within the channel's tolerance.

    ``measures`` is long: loc_id, lat, lon, date, source_rank, measure, value.
    """
    rule = lambda pick: F.create_map(*[F.lit(x) for c, r in channels.items() for x in (r[0], pick(c, r))])
    usable = F.lit(False)
    for ranks in {r[1] for r in channels.values()}:
        names = [r[0] for r in channels.values() if r[1] == ranks]
        usable = usable | (F.col("measure").isin(*names) & F.col("source_rank").isin(*ranks))
    named = measures.filter(usable & F.col("value").isNotNull()).withColumns(
        {
            "channel": F.element_at(rule(lambda c, r: c), F.col("measure")),
            "tolerance": F.element_at(rule(lambda c, r: r[2]), F.col("measure")),
        }
    )
    return first_in_window_spans(named, ["channel", "loc_id", "lat", "lon"], F.col("tolerance"))


def raw_cube(measures: DataFrame, grid: Grid, k: int = 10, channels: dict = RAW_CHANNELS) -> DataFrame:
    """Interpolated raw channels of every day from the first reading to the last: date, row_idx, col_idx, one column per channel."""
    spans = staged(channel_spans(measures, channels), "spans")  # read for the days and for the values
    first, last = measures.agg(F.min("date"), F.max("date")).first()
    if first is None:
        return measures.sparkSession.createDataFrame([], "date date, row_idx int, col_idx int" + "".join(f", {c} double" for c in channels))
    return interpolate_spans(spans, first, last, grid, list(channels), k)


def derive_channels(wide: DataFrame) -> DataFrame:
    """All derived channels from the wide raw table (date, row_idx, col_idx, one column per raw channel)."""
    cell = ["row_idx", "col_idx"]
    sin, cos = month_cycle(F.col("date"))
    base = wide.withColumns(
        {
            "din": sum_present(F.col("no3_nitrogen"), F.col("nh4_nitrogen")),
            "precipitation": F.coalesce("precipitation", F.lit(0.0)),
            "month_sin": sin,
            "month_cos": cos,
            "current_speed": F.hypot("current_u", "current_v"),
        }
    ).withColumn("np_ratio", guarded_ratio(F.col("din"), F.col("dip")))
    timed = rolling_means(base, cell, "sst").withColumnsRenamed({"mean_7d": "sst_7d_avg", "mean_30d": "sst_30d_avg"})
    timed = rolling_means(timed, cell, "chlorophyll_a").withColumnRenamed("mean_7d", "chl_7d_avg").drop("mean_30d")
    timed = rolling_means(timed, cell, "nir_idx").withColumnRenamed("mean_7d", "nir_7d_avg").drop("mean_30d")
    timed = days_since_rain(timed, cell, "precipitation").withColumn(
        "sst_anomaly", F.col("sst") - F.col("sst_30d_avg")
    )
    graded = spatial_gradient(timed, "sst").withColumnRenamed("gradient", "sst_gradient")
    return graded.select("date", *cell, *[F.col(c).cast("double").alias(c) for c in fx.CHANNELS])


def fill_cube(cube: DataFrame) -> DataFrame:
    """Forward-fill every channel per cell, then replace the rest by the channel mean (0 if none)."""
    filled = staged(forward_fill(cube, ["row_idx", "col_idx"], fx.CHANNELS), "filled")  # read for the means and for the values
    return mean_fill(filled, fx.CHANNELS)


def channel_cube(measures: DataFrame, grid: Grid, k: int = 10) -> DataFrame:
    """32-channel cube of every day from the first reading to the last. Missing cells stay NULL until ``fill_cube``."""
    return derive_channels(raw_cube(with_wind_vector(measures), grid, k))


def label_cube(filled: DataFrame, events: Sequence[tuple]) -> DataFrame:
    """Deficit index and label of every cell and day of a filled cube."""
    return adi_labels(filled.select("date", "row_idx", "col_idx", "din", "sst"), ["row_idx", "col_idx"], events)


def to_long(df: DataFrame, ids: list[str], channels: list[str]) -> DataFrame:
    return df.unpivot(ids, channels, "channel", "value")


def norm_stats(long: DataFrame, channel: str = "channel", value: str = "value") -> DataFrame:
    """Count, mean, deviation, min and max per channel from stably merged moments; neutral values when empty."""
    v = F.col(value)
    some = F.col("n") > 0
    return (
        long.groupBy(channel)
        .agg(
            F.count(v).alias("n"), F.avg(v).alias("_m"), F.stddev_pop(v).alias("_sd"),
            F.min(v).alias("_lo"), F.max(v).alias("_hi"),
        )
        .select(
            channel, "n",
            F.when(some, F.col("_m")).otherwise(0.0).alias("mean"),
            F.when(some, F.greatest("_sd", F.lit(1e-8))).otherwise(1.0).alias("std"),
            F.coalesce("_lo", F.lit(0.0)).alias("min"),
            F.coalesce("_hi", F.lit(0.0)).alias("max"),
        )
    )


def norm_stats_batch(long: DataFrame, channel: str = "channel", value: str = "value") -> DataFrame:
    return long.groupBy(channel).agg(
        F.avg(value).alias("mean"), (F.stddev_pop(value) + 1e-8).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


def norm_stats_merge(long: DataFrame, channel: str = "channel", value: str = "value") -> DataFrame:
    """Statistics of a merged cube; a flat channel gets unit deviation."""
    spread = F.stddev_pop(value)
    return long.groupBy(channel).agg(
        F.avg(value).alias("mean"), F.when(spread <= 1e-8, 1.0).otherwise(spread).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


def zscore_scale(long: DataFrame, stats: DataFrame, channel: str = "channel", value: str = "value") -> DataFrame:
    std = F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std"))
    return long.join(stats.select(channel, "mean", "std"), channel).withColumn(
        "scaled", (F.col(value) - F.col("mean")) / std
    )


def label_distribution(labels: DataFrame, label: str = "label") -> DataFrame:
    """Count and share per label, ignored cells included."""
    total = labels.select(F.count("*")).scalar()
    return labels.groupBy(label).agg(F.count("*").alias("n")).withColumn("pct", F.col("n") * 100.0 / total)


def year_label_rollup(labels: DataFrame) -> DataFrame:
    """Counts per (year, label), per year and overall, with the abnormal count."""
    return (
        labels.withColumn("year", F.year("date"))
        .rollup("year", "label")
        .agg(F.count("*").alias("n"), F.count_if(F.col("label") > 0).alias("n_abnormal"))
    )


def merge_prefer_new(old: DataFrame, new: DataFrame, date: str = "date") -> DataFrame:
    """``new`` replaces every date it covers; the other dates come from ``old``."""
    return old.join(new.select(date).distinct(), date, "left_anti").unionByName(new, allowMissingColumns=True)


def label_percentiles(daily_means: DataFrame, label: str, value: str) -> DataFrame:
    """Size, mean, deviation and linear percentiles of a value per label, rounded to four places."""
    daily_means = staged(daily_means, "daily-means")  # one row per day, read twice below
    quantiles = exact_quantiles(
        daily_means, [label], value, {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    )
    moments = daily_means.groupBy(label).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )
    joined = join_null_safe(moments, quantiles, [label], "left")
    return joined.select(
        label, "n", *[round_half_up(F.col(c), 4).alias(c) for c in ("mean", "std", "p10", "p25", "p50", "p75", "p90")]
    )


def threshold_midpoints(profile: DataFrame, label: str = "label") -> DataFrame:
    """Midpoints between neighbouring label medians and the percentage drop against label 0.

    The profile has one row per label, so the window over labels is a handful of rows.
    """
    nxt = F.lead("p50").over(Window.orderBy(label))
    base = profile.filter(F.col(label) == 0).select(F.max("p50")).scalar()
    return profile.select(
        label, "p50",
        ((F.col("p50") + nxt) / 2.0).alias("midpoint_to_next"),
        ((F.lit(1.0) - F.col("p50") / base) * 100.0).alias("drop_pct"),
    )


def area_fraction(labels: DataFrame, date: str = "date") -> DataFrame:
    """Valid cell count and share of cells at or above each stage per day."""
    valid = F.count_if(F.col("label") >= 0)
    share = lambda s: F.coalesce(F.count_if(F.col("label") >= s) / F.nullif(valid, F.lit(0)), F.lit(0.0))
    return labels.groupBy(date).agg(
        valid.alias("valid_cells"), *[share(s).alias(f"frac_{s}") for s in (1, 2, 3)]
    )
