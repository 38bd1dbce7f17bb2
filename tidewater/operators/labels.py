"""Deficit index and label operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions import seasons
from ..plans.ordering import join_null_safe
from ..plans.scan import accumulate, affine
from .temporal import day_weight


def adi_index(
    dense: DataFrame,
    cell: list[str],
    threshold: float = fx.DIN_DEFICIT_UGL,
    decay: float = fx.ADI_DECAY,
    ceiling: float = fx.ADI_CEILING,
    carry: DataFrame | None = None,
) -> DataFrame:
    """Accumulated deficit per cell and date of the harvest season.

    A day with a deficit (or no reading) adds the day's weight up to ``ceiling``; any other day multiplies the
    index by ``decay``. Both are clamped affine steps, so histories are scanned in stretches that are spread over tasks.
    ``carry`` (cell, season, adi) continues histories that an earlier call has already walked.
    """
    weights = day_weight(dense)
    days = (
        dense.filter(seasons.in_season(F.col("date")))
        .join(weights, "date")
        .withColumn("season", seasons.season_id(F.col("date")))
        .withColumn("deficit", F.col("din").isNull() | (F.col("din") <= threshold))
    )
    keys = [*cell, "season"]
    if carry is not None:
        days = join_null_safe(days, carry.select(*keys, F.col("adi").alias("_from")), keys, "left")
    rising = F.col("deficit")
    step = affine(F.when(rising, 1.0).otherwise(decay), F.when(rising, F.col("weight")).otherwise(0.0), F.when(rising, ceiling).otherwise(F.lit(math.inf)))
    start = F.lit(0.0) if carry is None else F.coalesce("_from", F.lit(0.0))
    walked = accumulate(days.withColumn("_day", F.unix_date("date")), keys, "_day", step, "adi", start)
    return walked.select(*keys, "date", "adi")


def replay_adi(dense: DataFrame, cell: list[str]) -> DataFrame:
    """The index of ``adi_index`` from an ordered replay of each cell, as the stream of its days would give it."""
    from ..streaming.processors import DeficitIndex

    days = dense.filter(seasons.in_season(F.col("date"))).join(day_weight(dense), "date").select(
        *cell, "date", seasons.season_id(F.col("date")).cast("int").alias("season"), F.col("din").cast("double"), F.col("weight").cast("double"))
    replay = DeficitIndex(fx.DIN_DEFICIT_UGL, fx.ADI_DECAY, fx.ADI_CEILING).replay
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in days.schema if f.name not in ("din", "weight"))
    return days.groupBy(*cell).applyInPandas(lambda rows: replay(rows), f"{columns}, adi double")


def adi_stage(adi):
    one, two, three = fx.ADI_STAGES
    return F.when(adi >= three, 3).when(adi >= two, 2).when(adi >= one, 1).otherwise(0)


def adi_labels(dense: DataFrame, cell: list[str], events: Sequence[tuple]) -> DataFrame:
    """-1 off season; index stage inside or around an event; 0 otherwise."""
    index = adi_index(dense, cell).drop("season")
    inside, around = seasons.event_flags(F.col("date"), events)
    label = (
        F.when(~seasons.in_season(F.col("date")), -1)
        .when(inside | around, adi_stage(F.col("adi")))
        .otherwise(0)
    )
    return dense.select(*cell, "date").join(index, [*cell, "date"], "left").withColumn("label", label)


def event_dates(spark: SparkSession, events: Sequence[tuple], every: int = 5, cap: int = 30) -> DataFrame:
    """Every fifth day of each event, at most ``cap`` per event, with its week label."""
    table = spark.createDataFrame(
        [(i, str(e[0]), str(e[1])) for i, e in enumerate(events)], "event_no INT, start STRING, end STRING"
    )
    days = table.select(
        "event_no",
        F.explode(
            F.slice(seasons.every_k_days(F.col("start").cast("date"), F.col("end").cast("date"), every), 1, cap)
        ).alias("date"),
    )
    return days.withColumn("label", seasons.event_week_label(F.col("date"), events)).filter(F.col("label") >= 0)


def month_quota_sample(dates: DataFrame, events: Sequence[tuple], n: int, rank_expr) -> DataFrame:
    """Dates away from every buffered event, an equal quota per month, at most ``n`` in total.

    ``rank_expr`` is a deterministic pseudo-random order. The input is a calendar, so its size is bounded by days.
    """
    safe = F.lit(True)
    for event in events:
        safe = safe & ~F.col("date").between(
            F.date_sub(F.lit(event[0]).cast("date"), fx.PRE_EVENT_BUFFER_DAYS),
            F.date_add(F.lit(event[1]).cast("date"), fx.POST_EVENT_BUFFER_DAYS),
        )
    pool = dates.filter(safe).withColumn("month", F.month("date")).withColumn("_r", rank_expr)
    months = pool.select(F.count_distinct("month")).scalar()
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) / months))
    w = Window.partitionBy("month").orderBy("_r", "date")
    return (
        pool.withColumn("_k", F.row_number().over(w))
        .filter(F.col("_k") <= quota)
        .orderBy("_r", "date")
        .limit(n)
        .drop("_r", "_k")
    )
