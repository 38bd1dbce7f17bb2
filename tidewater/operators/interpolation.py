"""Inverse-distance interpolation of point readings onto a regular grid.

A task holds the readings of some days and the cells of one tile. It orders the places once by their distance to every cell and
walks each cell's order until it has met k places that have a value on the day, so dense and sparse days take the same way and the
result is the exact k-nearest interpolation. Readings travel once per tile and stretch of days, not once per cell. Where a stretch holds
very many, its places are dealt into parts first, and each part keeps those that are among its k nearest of a cell on some day.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells along an edge of a tile, and days, that one task interpolates together
TILE, DAYS = 64, 64
#: Values that one step looks at
STEP = 1 << 21
#: Rows of a stretch of days that one task takes
ROWS = 250_000


@dataclass(frozen=True)
class Grid:
    box: tuple[float, float, float, float]
    h: int
    w: int

    @property
    def tiles(self) -> int:
        return -(-self.h // TILE) * -(-self.w // TILE)

    def cells(self, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, column, latitude and longitude of the cells of a tile."""
        up, along = divmod(tile, -(-self.w // TILE))
        rows = np.arange(up * TILE, min((up + 1) * TILE, self.h))
        cols = np.arange(along * TILE, min((along + 1) * TILE, self.w))
        r, c = np.repeat(rows, len(cols)), np.tile(cols, len(rows))
        lat_min, lat_max, lon_min, lon_max = self.box
        lat = lat_min + r * ((lat_max - lat_min) / (self.h - 1))
        lon = lon_min + c * ((lon_max - lon_min) / (self.w - 1))
        return r, c, lat, lon


def blend(
    values: np.ndarray, lat: np.ndarray, lon: np.ndarray, cell_lat: np.ndarray, cell_lon: np.ndarray, k: int, power: float,
    used: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """(value, number of places) per day and cell from ``values`` per day and place, NaN where a place has none.

    Of places at the same distance the first counts. Days without any value give NaN and 0. ``used`` marks the places behind any value.
    """
    out = np.full((len(values), len(cell_lat)), np.nan)
    count = np.zeros(out.shape, np.int64)
    known = ~np.isnan(values)
    need = np.minimum(known.sum(axis=1), k)
    some = max(1, STEP // max(1, values.shape[1]))
    for first in range(0, len(cell_lat), some):
        own = slice(first, first + some)
        out[:, own], count[:, own] = _blend_cells(values, need, lat, lon, cell_lat[own], cell_lon[own], k, power, used)
    return out, count


def _blend_cells(values, need, lat, lon, cell_lat, cell_lon, k, power, used) -> tuple[np.ndarray, np.ndarray]:
    dist2 = (cell_lat[:, None] - lat) ** 2 + (cell_lon[:, None] - lon) ** 2
    order = np.argsort(dist2, axis=1, kind="stable")
    weight = 1.0 / np.maximum(np.sqrt(dist2), 1e-6) ** power
    out = np.full((len(values), len(dist2)), np.nan)
    count = np.zeros(out.shape, np.int64)
    day, cell = np.nonzero(np.broadcast_to(need[:, None] > 0, out.shape))
    reach = min(2 * k, values.shape[1])
    while len(day):
        left = []
        for at in range(0, len(day), max(1, STEP // reach)):
            d, c = day[at : at + max(1, STEP // reach)], cell[at : at + max(1, STEP // reach)]
            near = order[c, :reach]
            seen = values[d[:, None], near]
            met = ~np.isnan(seen)
            so_far = met.cumsum(axis=1)
            met &= so_far <= k
            enough = so_far[:, -1] >= need[d]
            w = np.where(met, weight[c[:, None], near], 0.0)
            d_, c_ = d[enough], c[enough]
            out[d_, c_] = ((w * np.where(met, seen, 0.0)).sum(axis=1) / np.maximum(w.sum(axis=1), 1e-300))[enough]
            count[d_, c_] = met.sum(axis=1)[enough]
            if used is not None:
                used[near[enough][met[enough]]] = True
            left.append((d[~enough], c[~enough]))
        day, cell = (np.concatenate([x[i] for x in left]) for i in (0, 1))
        reach = min(4 * reach, values.shape[1])
    return out, count


def _places(loc: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latitude and longitude of the distinct places in the order of their ids, and the place of every row."""
    order = np.lexsort((lon, lat, loc))
    a, b, c = loc[order], lat[order], lon[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1]))
    place = np.empty(len(loc), np.int64)
    place[order] = np.cumsum(new) - 1
    return b[new], c[new], place


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.asarray(table.column(n).to_pandas()) for n in names]


def _one_group(grid: Grid, k: int, power: float, keys: list[str]) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        loc, lat, lon, value = _columns(table, "loc_id", "lat", "lon", "value")
        at_lat, at_lon, place = _places(loc, lat, lon)
        values = np.full((1, len(at_lat)), np.nan)
        values[0, place] = value
        r, c, cell_lat, cell_lon = grid.cells(key[-1].as_py())
        out, count = blend(values, at_lat, at_lon, cell_lat, cell_lon, k, power)
        made = {name: pa.array([v.as_py()] * len(r), v.type) for name, v in zip(keys, key)}
        return pa.table(made | {
            "row_idx": pa.array(r, pa.int32()), "col_idx": pa.array(c, pa.int32()),
            "value": pa.array(out[0], pa.float64(), from_pandas=True), "n_points": pa.array(count[0], pa.int64()),
        })

    return run


def interpolate_grid(
    points: DataFrame, box: tuple[float, float, float, float], h: int, w: int, by: tuple[str, ...], k: int = 10, power: float = 2.0
) -> DataFrame:
    """(by, row_idx, col_idx, value, n_points): inverse-distance interpolation of ``points(by, loc_id, lat, lon, value)`` on an h x w grid.

    A location occurs once per ``by`` group, so a group is as large as the number of locations. Missing values take no part;
    a group without any value has no rows. Of locations at equal distance that with the smaller id counts.
    """
    grid, by = Grid(box, h, w), list(by)
    known = points.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    dealt = known.select(*by, "loc_id", "lat", "lon", F.col("value").cast("double").alias("value"), F.explode(F.sequence(F.lit(0), F.lit(grid.tiles - 1))).alias("_tile"))
    types = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{types}, row_idx int, col_idx int, value double, n_points bigint"
    return dealt.groupBy(*by, "_tile").applyInArrow(_one_group(grid, k, power, by), schema)


def _by_day(rank, value, begin, end, place, n_days: int, n_places: int) -> np.ndarray:
    """Values per day and place; where rows overlap, that of the lowest rank, which is written last, stays."""
    values = np.full((n_days, n_places), np.nan)
    for i in np.argsort(-rank, kind="stable").tolist():
        values[max(int(begin[i]), 0) : int(end[i]) + 1, place[i]] = value[i]
    return values


def _near_any(grid: Grid, first: int, last: int, k: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """The rows of the places that are among the k nearest of a cell of the tile on any day of the stretch, for one channel and part."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        start = first + key[1].as_py() * DAYS
        n_days = min(DAYS, last - start + 1)
        _, _, cell_lat, cell_lon = grid.cells(key[0].as_py())
        rank, loc, lat, lon, value, begin, end = _columns(table, "source_rank", "loc_id", "lat", "lon", "value", "first_day", "last_day")
        at_lat, at_lon, place = _places(loc, lat, lon)
        used = np.zeros(len(at_lat), bool)
        values = _by_day(rank, value, begin - start, end - start, place, n_days, len(at_lat))
        blend(values, at_lat, at_lon, cell_lat, cell_lon, k, 2.0, used)
        return table.filter(pa.array(used[place])).drop_columns(["_part"])

    return run


def _days_of_tile(grid: Grid, first: int, last: int, channels: list[str], k: int, power: float, counted: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        start = first + key[1].as_py() * DAYS
        n_days = min(DAYS, last - start + 1)
        r, c, cell_lat, cell_lon = grid.cells(key[0].as_py())
        channel, rank, loc, lat, lon, value, begin, end = _columns(table, "channel", "source_rank", "loc_id", "lat", "lon", "value", "first_day", "last_day")
        made = {
            "date": pa.array(np.repeat(np.arange(start, start + n_days), len(r)), pa.int32()).cast(pa.date32()),
            "row_idx": pa.array(np.tile(r, n_days), pa.int32()), "col_idx": pa.array(np.tile(c, n_days), pa.int32()),
        }
        for name in channels:
            own = np.flatnonzero(channel == name)
            out, count = np.full((n_days, len(r)), np.nan), np.zeros((n_days, len(r)), np.int64)
            if len(own):
                at_lat, at_lon, place = _places(loc[own], lat[own], lon[own])
                values = _by_day(rank[own], value[own], begin[own] - start, end[own] - start, place, n_days, len(at_lat))
                out, count = blend(values, at_lat, at_lon, cell_lat, cell_lon, k, power)
            made[name] = pa.array(out.ravel(), pa.float64(), from_pandas=True)
            if counted:
                made[f"n_{name}"] = pa.array(count.ravel(), pa.int64())
        return pa.table(made)

    return run


def interpolate_spans(
    spans: DataFrame, first: date, last: date, grid: Grid, channels: list[str], k: int = 10, power: float = 2.0, counted: bool = False
) -> DataFrame:
    """(date, row_idx, col_idx, one column per channel) for every day from ``first`` to ``last`` and every cell of the grid.

    ``spans`` holds channel, source_rank, loc_id, lat, lon, value and the days first_day to last_day on which the value is the one of its
    place, source and channel; where sources overlap, that of the lowest rank counts. A channel is NULL on days without any value.
    With ``counted`` also n_<channel>, the number of places behind each value.
    """
    from_day, to_day = (x.toordinal() - date(1970, 1, 1).toordinal() for x in (first, last))
    chunks = (to_day - from_day) // DAYS
    number = lambda c: F.unix_date(c)
    seen = spans.filter(F.col("value").isNotNull() & ~F.isnan("value")).select(
        "channel", F.col("source_rank").cast("int").alias("source_rank"), "loc_id", "lat", "lon", F.col("value").cast("double").alias("value"),
        F.greatest(number("first_day"), F.lit(from_day)).alias("first_day"), F.least(number("last_day"), F.lit(to_day)).alias("last_day"),
    ).filter("first_day <= last_day")
    chunk = lambda c: F.floor((F.col(c) - from_day) / DAYS).cast("int")
    tiles = F.sequence(F.lit(0), F.lit(grid.tiles - 1))
    dealt = seen.withColumn("_chunk", F.explode(F.sequence(chunk("first_day"), chunk("last_day")))).withColumn("_tile", F.explode(tiles))
    most = dealt.groupBy("_chunk", "channel").count().groupBy("_chunk").agg(F.max("count").alias("one"), F.sum("count").alias("all"))
    one, whole = most.agg(F.max("one"), F.max("all")).first()
    if (whole or 0) > ROWS * grid.tiles:
        parted = dealt.withColumn("_part", F.pmod(F.xxhash64("loc_id", "lat", "lon"), F.lit(-(-one // (ROWS * grid.tiles)))).cast("int"))
        rows = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
        dealt = parted.groupBy("_tile", "_chunk", "channel", "_part").applyInArrow(_near_any(grid, from_day, to_day, k), rows)
    # A row without a channel stands for every tile and stretch of days, so those without readings appear too
    bare = spans.sparkSession.range(chunks + 1).select(F.col("id").cast("int").alias("_chunk"), F.explode(tiles).alias("_tile"))
    every = dealt.unionByName(bare, allowMissingColumns=True)
    schema = "date date, row_idx int, col_idx int" + "".join(f", {c} double" + f", n_{c} bigint" * counted for c in channels)
    return every.groupBy("_tile", "_chunk").applyInArrow(_days_of_tile(grid, from_day, to_day, channels, k, power, counted), schema)


# Functions for Python workers travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
