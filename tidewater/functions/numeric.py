"""Null-aware arithmetic, parsing, rounding, bucketing and array helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fx


def to_double(text: Column) -> Column:
    """Text to DOUBLE, unparseable text to NULL."""
    return text.try_cast("double")


def first_timestamp(text: Column, formats: Sequence[str]) -> Column:
    """First format that parses wins; unparseable text gives NULL."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def yearless_timestamp(text: Column, year: Column) -> Column:
    """'MM-dd HH시', 'yyyy-MM-dd HH시' or ISO text; a missing year is taken from ``year``."""
    clean = F.replace(F.trim(text), F.lit("시"), F.lit(":00"))
    dated = F.when(clean.rlike(r"^\d{1,2}-\d{1,2} "), F.concat_ws("-", year.cast("string"), clean)).otherwise(clean)
    return first_timestamp(dated, ["yyyy-MM-dd HH:mm", "yyyy-M-d H:mm", "yyyy-MM-dd'T'HH:mm:ss"])


def wind_degrees(text: Column) -> Column:
    """Compass text (English or Korean) to degrees; numbers pass through."""
    table = F.create_map(*[F.lit(x) for kv in fx.WIND_DEGREES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(text))), to_double(text))


def falsy_coalesce(*values: Column, default: float | None = None) -> Column:
    """First value that is neither NULL nor zero, else ``default``."""
    tail = [] if default is None else [F.lit(float(default))]
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values], *tail)


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator)


def sum_present(a: Column, b: Column) -> Column:
    """Sum that counts one missing side as zero and two missing sides as missing."""
    return F.when(
        a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))
    )


def clamp(value: Column, low: float, high: float) -> Column:
    """Clip to [low, high]; NULL stays NULL."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def within(value: Column, low: float, high: float) -> Column:
    """NULL outside the open interval."""
    return F.when((value > low) & (value < high), value)


def wind_vector(degrees: Column) -> tuple[Column, Column]:
    return F.sin(F.radians(degrees)), F.cos(F.radians(degrees))


def month_cycle(date: Column) -> tuple[Column, Column]:
    angle = (F.month(date) - 1) * F.lit(2.0) * F.pi() / F.lit(12.0)
    return F.sin(angle), F.cos(angle)


def step_bucket(value: Column, cuts: Sequence[tuple[float, object]], lowest: object) -> Column:
    """Highest cut not above ``value`` decides; ``lowest`` below every cut."""
    out = None
    for cut, label in sorted(cuts, key=lambda c: -c[0]):
        out = F.when(value >= cut, F.lit(label)) if out is None else out.when(value >= cut, F.lit(label))
    return F.when(value.isNotNull(), out.otherwise(F.lit(lowest)))


def lookup(value: Column, table: Mapping, default=None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, value)
    return found if default is None else F.coalesce(found, F.lit(default))


def round_half_up(value: Column, digits: int) -> Column:
    """Half-up rounding after removing binary noise beyond ten places."""
    return F.round(F.round(value, 10), digits)


def round_even(value: Column, digits: int) -> Column:
    """Half-to-even rounding after removing binary noise beyond ten places."""
    return F.bround(F.round(value, 10), digits)


def softmax(values: Column) -> Column:
    """Softmax of a numeric array."""
    shifted = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(shifted, lambda x: x / total)


def argmax(values: Column) -> Column:
    """Zero-based index of the first maximum."""
    return F.array_position(values, F.array_max(values)) - 1


def threshold_status(feature: Column, value: Column, thresholds: Mapping[str, float], low_is_risk) -> Column:
    """BELOW/ABOVE_THRESHOLD per feature, UNKNOWN for missing values."""
    limit = lookup(feature, thresholds)
    low = feature.isin(*low_is_risk)
    return (
        F.when(value.isNull() | limit.isNull(), "UNKNOWN")
        .when(low & (value < limit), "BELOW_THRESHOLD")
        .when(low, "ABOVE_THRESHOLD")
        .when(value > limit, "ABOVE_THRESHOLD")
        .otherwise("BELOW_THRESHOLD")
    )


def scaled_feature(name: str, value: Column) -> Column:
    """One model input: missing value replaced by its default, then centred and scaled."""
    default, centre, scale = fx.FEATURE_SCALING[name]
    return (F.coalesce(value, F.lit(default)) - F.lit(centre)) / F.lit(scale)
