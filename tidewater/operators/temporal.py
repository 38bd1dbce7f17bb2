"""Latest-value lookups, range / interval / as-of joins and time-window features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import seasons


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key as a partially aggregated maximum, so a large key never sorts in one task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = F.max(F.struct(*order, *rest)).alias("_m")
    return df.groupBy(*keys).agg(picked).select(*keys, "_m.*")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = F.min(F.struct(*order, *rest)).alias("_m")
    return df.groupBy(*keys).agg(picked).select(*keys, "_m.*")


def last_n_per_key(df: DataFrame, keys: list[str], order: list[str], n: int, name: str = "recency") -> DataFrame:
    """Last ``n`` rows per key; the row limit is applied inside each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def latest_per_column(df: DataFrame, keys: list[str], time: Column, columns: list[str]) -> DataFrame:
    """Independent latest non-null value per column."""
    return df.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), time)).alias(c) for c in columns]
    )


def within_days(targets: DataFrame, points: DataFrame, tolerance: int, target_date: str, point_date: str) -> DataFrame:
    """Pairs with \\|point_date - target_date\\| <= tolerance as an equi-join on day buckets."""
    width = tolerance + 1
    t = targets.withColumn("_b", F.floor(F.unix_date(target_date) / width)).withColumn(
        "_b", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1))
    )
    p = points.withColumn("_b", F.floor(F.unix_date(point_date) / width))
    return t.join(p, "_b").filter(F.abs(F.datediff(target_date, point_date)) <= tolerance).drop("_b")


def first_in_window_spans(points: DataFrame, location: list[str], tolerance: Column | int, rank: str = "source_rank") -> DataFrame:
    """(location, rank, value, first_day, last_day): the target days for which a reading is the earliest of its source in the window.

    A window reaches ``tolerance`` days before and after its target, so a reading is the earliest from the day on which the one before
    has left the window, or it enters itself, until it leaves. Readings are first reduced to one per (location, source, day), so
    every partition is bounded by the calendar, and a reading stays one row however many targets it serves.
    """
    width = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    once = points.filter(F.col("value").isNotNull()).groupBy(*location, "date", rank, width.alias("_width")).agg(F.min("value").alias("value"))
    before = F.lag("date").over(Window.partitionBy(*location, rank).orderBy("date"))
    first = F.greatest(F.expr("date_sub(date, _width)"), F.date_add(before, F.col("_width") + 1))
    return once.withColumn("first_day", first).select(
        *location, rank, "value", F.col("first_day"), F.expr("date_add(date, _width)").alias("last_day")
    ).filter("first_day <= last_day")


def first_in_window(points: DataFrame, dates: DataFrame, location: list[str], tolerance: int, rank: str = "source_rank") -> DataFrame:
    """Per (target date, location): the reading with the lowest source rank, then earliest date, within tolerance.

    ``points`` holds ``location``, ``date``, ``rank``, ``value``; ``dates`` holds the target ``date``. Each reading is spread over just
    the days that it answers for.
    """
    spans = first_in_window_spans(points, location, tolerance, rank)
    reached = spans.withColumn("date", F.explode(F.sequence("first_day", "last_day")))
    near = reached.join(dates.select("date").distinct(), "date", "left_semi")
    picked = F.min(F.struct(rank, "value")).alias("_m")
    return near.groupBy("date", *location).agg(picked).select("date", *location, F.col("_m.value").alias("value"))


def interval_events(dates: DataFrame, events: DataFrame, date: str = "date", before: int = 0, after: int = 0) -> DataFrame:
    """Dates joined to every covering event; events are spread over the days they cover, so the join is on equality."""
    covered = events.withColumn(
        date,
        F.explode(
            F.sequence(F.date_sub("start", before), F.date_add("end", after), F.expr("INTERVAL 1 DAY"))
        ),
    )
    return dates.join(covered, date)


def previous_date(df: DataFrame, date: str = "date", max_gap: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each occurring date (per key) with the previous occurring date, if at most ``max_gap`` days earlier.

    Dates are made distinct first, so every window partition is bounded by the calendar.
    """
    days = df.select(*keys, date).distinct()
    prev = F.lag(date).over(Window.partitionBy(*keys).orderBy(date))
    return days.withColumn("prev_date", prev).withColumn(
        "prev_date", F.when(F.datediff(date, F.col("prev_date")) <= max_gap, F.col("prev_date"))
    )


def trailing(keys: list[str], date: str, rows: int):
    return Window.partitionBy(*keys).orderBy(date).rowsBetween(-rows, 0)


def rolling_means(df: DataFrame, keys: list[str], value: str, week_rows: int = 7, month_rows: int = 31) -> DataFrame:
    """NULL-skipping means of the last ``week_rows`` and ``month_rows`` rows, current row included."""
    return df.withColumn("mean_7d", F.avg(value).over(trailing(keys, "date", week_rows - 1))).withColumn(
        "mean_30d", F.avg(value).over(trailing(keys, "date", month_rows - 1))
    )


def days_since_rain(df: DataFrame, keys: list[str], rain: str, wet: float = 0.5) -> DataFrame:
    """Rows since the last wet row; counting starts at zero on the first row."""
    w = Window.partitionBy(*keys).orderBy("date")
    position = F.row_number().over(w)
    numbered = df.withColumn("_pos", position)
    anchor = F.when((F.col(rain) > wet) | (F.col("_pos") == 1), F.col("_pos"))
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    return numbered.withColumn(
        "days_since_rain", F.col("_pos") - F.last(anchor, ignorenulls=True).over(past)
    ).drop("_pos")


def forward_fill(df: DataFrame, keys: list[str], columns: list[str], date: str = "date") -> DataFrame:
    past = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in columns})


def mean_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace what is still missing by the column mean, zero for an all-missing column.

    The means are one row, taken at once in one pass; pass a written table if ``df`` is dear to compute.
    """
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(means[c]).cast("double"), F.lit(0.0)) for c in columns})


def lag_difference(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("date")
    return df.withColumn(name, F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0)))


def change_mask(df: DataFrame, keys: list[str], value: str, name: str = "changed") -> DataFrame:
    """1 on the first row and wherever the value moved by more than 1e-8 + 1e-5 * |previous|."""
    w = Window.partitionBy(*keys).orderBy("date")
    prev = F.lag(value).over(w)
    moved = F.abs(F.col(value) - prev) > F.lit(1e-8) + F.lit(1e-5) * F.abs(prev)
    return df.withColumn(name, F.when(F.row_number().over(w) == 1, 1).when(moved | F.col(value).isNull() | prev.isNull(), 1).otherwise(0))


def day_weight(daily: DataFrame, sst: str = "sst") -> DataFrame:
    """One deficit weight per date from the domain-mean temperature."""
    return daily.groupBy("date").agg(F.avg(sst).alias("day_sst")).select(
        "date", seasons.sst_weight(F.col("day_sst")).alias("weight")
    )


def deficit_features(daily: DataFrame, keys: list[str], din: str = "din", threshold: float = 70.0) -> DataFrame:
    """Weighted deficit, its 29- and 59-row trailing sums and the day-over-day change of the nutrient."""
    scored = daily.join(day_weight(daily), "date").withColumn(
        "daily_score", F.greatest(F.lit(threshold) - F.col(din), F.lit(0.0)) * F.col("weight")
    )
    w29 = trailing(keys, "date", 28)
    w59 = trailing(keys, "date", 58)
    return lag_difference(
        scored.withColumn("deficit_30d", F.sum("daily_score").over(w29)).withColumn(
            "deficit_60d", F.sum("daily_score").over(w59)
        ),
        keys, din, "din_diff",
    )
