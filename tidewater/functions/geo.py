"""Distances, grids and pixel addressing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fx
from .numeric import clamp

EARTH_KM = 6371.0088


def squared_degrees(lat1, lon1, lat2, lon2) -> Column:
    return (lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2)


def great_circle_km(lat1, lon1, lat2, lon2) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def estuary_km(lat, lon) -> Column:
    dlat = (lat - F.lit(fx.ESTUARY[0])) * 111.0
    dlon = (lon - F.lit(fx.ESTUARY[1])) * 111.0 * F.cos(F.radians(lat))
    return F.sqrt(dlat * dlat + dlon * dlon)


def depth_proxy_m(lat, lon) -> Column:
    return clamp(F.lit(20.0) + estuary_km(lat, lon) * 0.1, 5.0, 100.0)


def grid_coordinate(index: Column, low: float, high: float, n: int) -> Column:
    """Evenly spaced coordinate for a zero-based index."""
    return F.lit(low) + index * F.lit((high - low) / (n - 1))


def pixel_index(value: Column, low: float, high: float, n: int, descending: bool = False) -> Column:
    """Cell number clamped to the grid."""
    along = (F.lit(high) - value) if descending else (value - F.lit(low))
    raw = F.floor(along / F.lit(high - low) * F.lit(float(n)))
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), raw)).cast("int")


def outside_box(lat, lon, box: tuple[float, float, float, float]) -> Column:
    lat_min, lat_max, lon_min, lon_max = box
    return ~(lat.between(lat_min, lat_max) & lon.between(lon_min, lon_max))
