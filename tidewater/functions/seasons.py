"""Season predicates, labels and date sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fx

Event = tuple  # (start, end, ...)


def in_season(date: Column, off_months: Sequence[int] = fx.OFF_SEASON_MONTHS) -> Column:
    return ~F.month(date).isin(*off_months)


def season_id(date: Column) -> Column:
    """Year in which the November-May season containing ``date`` started."""
    return F.when(F.month(date) >= 11, F.year(date)).otherwise(F.year(date) - 1)


def season_name(date: Column) -> Column:
    start = season_id(date)
    return F.concat_ws("-", start.cast("string"), (start + 1).cast("string"))


def every_k_days(start: Column, end: Column, k: int) -> Column:
    return F.sequence(start, end, F.expr(f"INTERVAL {int(k)} DAYS"))


def season_mid_months(start: Column, end: Column) -> Column:
    """Mid-month dates of the in-season months between two dates."""
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH"))
    return F.transform(F.filter(months, lambda m: in_season(m)), lambda m: F.date_add(m, 14))


def _days(iso: str) -> Column:
    return F.lit(iso).cast("date")


def event_flags(date: Column, events: Sequence[Event], buffer_days: int = fx.EVENT_BUFFER_DAYS) -> tuple[Column, Column]:
    """(inside an event, inside an event's surroundings) for a short parameter list of events."""
    inside, around = F.lit(False), F.lit(False)
    for event in events:
        start, end = _days(event[0]), _days(event[1])
        inside = inside | date.between(start, end)
        around = around | date.between(F.date_sub(start, buffer_days), F.date_add(end, buffer_days))
    return inside, around


def _first_event(date: Column, events: Sequence[Event], within_event, after) -> Column:
    """Label of the first event whose buffered span covers the date."""
    out = F.when(F.month(date).isin(*fx.NO_GROWTH_MONTHS, *fx.SEEDING_MONTHS), F.lit(-1))
    for event in events:
        start, end = _days(event[0]), _days(event[1])
        out = out.when((date >= F.date_sub(start, fx.PRE_EVENT_BUFFER_DAYS)) & (date < start), F.lit(-1))
        out = out.when((date > end) & (date <= F.date_add(end, fx.POST_EVENT_BUFFER_DAYS)), F.lit(-1))
        out = out.when(date.between(start, end), within_event(start))
    return out.otherwise(after)


def event_week_label(date: Column, events: Sequence[Event] = tuple(fx.BLEACHING_EVENTS)) -> Column:
    def by_week(start: Column) -> Column:
        weeks = F.datediff(date, start) / 7.0
        return F.when(weeks < fx.WATCH_END_WEEKS, 1).when(weeks < fx.ACTIVE_END_WEEKS, 2).otherwise(3)

    return _first_event(date, events, by_week, F.lit(0))


def chl_label(date: Column, chl: Column, events: Sequence[Event] = tuple(fx.BLEACHING_EVENTS)) -> Column:
    def by_chl(_start: Column) -> Column:
        return (
            F.when(chl.isNull() | F.isnan(chl), -1)
            .when(chl < fx.CHL_SEVERE, 3)
            .when(chl < fx.CHL_ACTIVE, 2)
            .when(chl < fx.CHL_WATCH, 1)
            .otherwise(0)
        )

    return _first_event(date, events, by_chl, F.lit(0))


def sst_weight(day_mean: Column) -> Column:
    """Deficit weight of a day from its domain-mean temperature."""
    filled = F.coalesce(day_mean, F.lit(fx.DEFAULT_DAY_SST))
    return F.when(filled >= 15.0, 1.5).when(filled >= 10.0, 1.0).otherwise(0.7)
