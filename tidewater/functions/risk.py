"""Risk index profiles, stages and class codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fx
from .numeric import clamp, falsy_coalesce, round_even, step_bucket


def _floor0(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def risk_parts(din, water_temp, np_ratio, dissolved_oxygen, salinity, din_ref=5.0, np_ref=10.0) -> dict[str, Column]:
    """Per-factor risk, zero when the factor is harmless."""
    return {
        "din": _floor0(F.lit(1.0) - din / F.lit(din_ref)),
        "water_temp": _floor0((water_temp - F.lit(20.0)) / F.lit(10.0)),
        "np_ratio": _floor0(F.lit(1.0) - np_ratio / F.lit(np_ref)),
        "dissolved_oxygen": _floor0(F.lit(1.0) - dissolved_oxygen / F.lit(5.0)),
        "salinity": _floor0((F.lit(32.0) - salinity) / F.lit(4.0)),
    }


def _weighted(parts: dict[str, Column]) -> Column:
    terms = [F.lit(w) * parts[name] for name, w in fx.RISK_WEIGHTS.items()]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return clamp(total, 0.0, 1.0)


def risk_index_molar(din, water_temp, np_ratio, dissolved_oxygen, salinity) -> Column:
    """Micromolar profile; missing factors take the neutral defaults."""
    return _weighted(
        risk_parts(
            F.coalesce(din, F.lit(5.0)),
            F.coalesce(water_temp, F.lit(15.0)),
            F.coalesce(np_ratio, F.lit(16.0)),
            F.coalesce(dissolved_oxygen, F.lit(8.0)),
            F.coalesce(salinity, F.lit(32.0)),
        )
    )


def risk_index_mass(din, water_temp, np_ratio, dissolved_oxygen, salinity) -> Column:
    """Microgram profile; zero counts as missing, result rounded to four places."""
    return round_even(
        _weighted(
            risk_parts(
                falsy_coalesce(din, default=100.0),
                falsy_coalesce(water_temp, default=15.0),
                falsy_coalesce(np_ratio, default=26.0),
                falsy_coalesce(dissolved_oxygen, default=8.0),
                falsy_coalesce(salinity, default=32.0),
                din_ref=70.0,
                np_ref=6.0,
            )
        ),
        4,
    )


def risk_index_grid(din, water_temp, np_ratio, dissolved_oxygen, salinity) -> Column:
    """Gridded profile: every factor is clipped to [0, 1] before weighting."""
    parts = risk_parts(din, water_temp, np_ratio, dissolved_oxygen, salinity)
    return _weighted({k: F.least(v, F.lit(1.0)) for k, v in parts.items()})


def risk_index_din_only(din) -> Column:
    return F.when(din == 0, F.lit(0.5)).otherwise(clamp(F.lit(1.0) - din / F.lit(20.0), 0.0, 1.0))


def risk_stage(score: Column) -> Column:
    return step_bucket(score, [(0.2, 1), (0.4, 2), (0.6, 3), (0.8, 4)], 0)


def severity_band(score: Column) -> Column:
    return step_bucket(score, [(0.3, "CAUTION"), (0.6, "WARNING"), (0.8, "DANGER")], "NORMAL")


def warn_class(warn: Column) -> Column:
    return step_bucket(warn, [(fx.WATCH_WARN, "watch"), (fx.SUSTAINED_WARN, "sustained")], "normal")


def nutrient_status(value: Column, danger: float, caution: float) -> Column:
    return F.when(value < danger, "DANGER").when(value < caution, "CAUTION").otherwise("NORMAL")
