"""Satellite band arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fx
from .numeric import guarded_ratio, within


def clear_pixel(flag: Column, mask: int = fx.BAD_PIXEL_MASK) -> Column:
    return flag.bitwiseAND(F.lit(mask)) == 0


def oc3_chlorophyll(b443: Column, b490: Column, b555: Column) -> Column:
    """Band-ratio chlorophyll, NULL outside (0, 200)."""
    r = F.log10(guarded_ratio(F.greatest(b443, b490), b555))
    exponent = F.lit(0.0)
    for power, coefficient in enumerate(fx.OC3_COEFFICIENTS):
        exponent = exponent + F.lit(coefficient) * F.pow(r, F.lit(float(power)))
    return within(F.pow(F.lit(10.0), exponent), 0.0, 200.0)


def nir_ratio(b865: Column, b555: Column) -> Column:
    return guarded_ratio(b865, b555)


def ndci(b04: Column, b05: Column, scene_class: Column) -> Column:
    """Red-edge chlorophyll index over water; digital number zero is no data."""
    red = F.nullif(b04, F.lit(0)).cast("double") * 1e-4
    edge = F.nullif(b05, F.lit(0)).cast("double") * 1e-4
    total = edge + red
    index = F.when(total > 1e-6, (edge - red) / total)
    return F.when((scene_class == fx.WATER_CLASS) & (F.abs(index) <= 1.0), index)
