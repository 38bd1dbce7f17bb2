"""Global and per-group order statistics that never put one group into one task.

Rows are cut into slices along the sort order by literal split points taken from
``percentile_approx``. Per-slice totals are small; their running sums give each slice
its starting offset, and the remaining work is a window inside one slice. Because the
split points are literals, a recomputed task lands in the same slice as before.
"""

from __future__ import annotations

import math
import os

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one slice should hold, and the most split points that are asked for at once
_SLICE_ROWS, _MAX_SLICES = 2_000_000, 10_000


def slice_count(df: DataFrame, rows: int) -> int:
    """At least one slice per shuffle partition, more once a slice would exceed ``_SLICE_ROWS``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return min(_MAX_SLICES, max(8, parts, -(-rows // _SLICE_ROWS)))


def _shared_prefix(df: DataFrame, name: str) -> int:
    """Bytes with which all values of a text column begin: those that its smallest and its largest value share."""
    raw = F.col(name).cast("binary")
    low, high = df.agg(F.min(raw), F.max(raw)).first()
    return len(os.path.commonprefix([bytes(low), bytes(high)])) if low is not None else 0


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL meets NULL; the keys of ``left`` stay."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(named[f"_r_{k}"])
    return left.join(named, same, how).drop(*[f"_r_{k}" for k in keys])


def _as_number(df: DataFrame, name: str, ascending: bool) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.DateType):
        num = F.unix_date(F.col(name)).cast("double")
    elif isinstance(dtype, T.TimestampType):
        num = F.unix_micros(F.col(name)).cast("double")
    elif isinstance(dtype, T.TimestampNTZType):
        num = F.unix_micros(F.to_utc_timestamp(F.col(name).cast("timestamp"), "UTC")).cast("double")
    elif isinstance(dtype, T.NumericType):
        num = F.col(name).cast("double")
    elif isinstance(dtype, T.BooleanType):
        num = F.col(name).cast("int").cast("double")
    elif isinstance(dtype, (T.StringType, T.BinaryType)):
        # The first six bytes after those that all values share, as a number: monotone in byte order, and exact in a double
        head = F.rpad(F.hex(F.substring(F.col(name).cast("binary"), _shared_prefix(df, name) + 1, 6)), 12, "0")
        num = F.conv(head, 16, 10).cast("double")
    else:
        raise TypeError(f"cannot slice on {name}: {dtype.simpleString()}")
    num = F.when(F.isnan(num), F.lit(math.inf)).otherwise(num)
    if ascending:
        return F.coalesce(num, F.lit(-math.inf))
    return F.coalesce(-num, F.lit(math.inf))


def split_points(df: DataFrame, value: Column, n: int | None = None) -> tuple[list[float], list[float]]:
    """Sorted split points of ``value`` plus the values that fill several slices alone."""
    def quantiles(n: int) -> Column:
        return F.percentile_approx(value, [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("p")

    # One pass for the number of rows and the points of as many slices as any table gets
    wanted = n or slice_count(df, 0)
    row = df.select(F.count("*").alias("n"), quantiles(wanted)).first()
    needed = n or slice_count(df, row["n"])
    if needed > wanted:
        row = df.select(quantiles(needed)).first()
    found = [float(x) for x in (row["p"] or [])]
    heavy = sorted({a for a, b in zip(found, found[1:]) if a == b and math.isfinite(a)})
    points = set(x for x in found if math.isfinite(x))
    points.update(math.nextafter(h, math.inf) for h in heavy)
    return sorted(points), heavy


def _bucket(df: DataFrame, points: list[float], source: str, target: str) -> DataFrame:
    if not points:
        return df.withColumn(target, F.lit(0.0))
    stage = Bucketizer(
        splits=[-math.inf, *points, math.inf], inputCol=source, outputCol=target, handleInvalid="keep"
    )
    return stage.transform(df)


def with_slices(df: DataFrame, order: list[tuple[str, bool]], n: int | None = None) -> DataFrame:
    """Add ``_s1``/``_s2`` so that (``_s1``, ``_s2``) is monotone in the sort order.

    A value that alone fills more than one slice gets a slice of its own and is cut
    again along the second sort column.
    """
    first, ascending = order[0]
    value = _as_number(df, first, ascending)
    points, heavy = split_points(df, value, n)
    out = _bucket(df.withColumn("_k1", value), points, "_k1", "_s1")
    if heavy and len(order) > 1:
        second, asc2 = order[1]
        value2 = _as_number(df, second, asc2)
        points2, _ = split_points(df, value2, n)
        out = _bucket(out.withColumn("_k2", value2), points2, "_k2", "_s2")
        out = out.withColumn("_s2", F.when(F.col("_k1").isin(heavy), F.col("_s2")).otherwise(0.0)).drop("_k2")
    else:
        out = out.withColumn("_s2", F.lit(0.0))
    return out.drop("_k1")


def sort_columns(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if asc else F.col(c).desc_nulls_last() for c, asc in order]


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[tuple[str, bool]],
    measures: dict[str, Column],
    n_slices: int | None = None,
) -> DataFrame:
    """Inclusive running sums of ``measures`` along ``order`` inside each key."""
    measured = df.withColumns({f"_m_{name}": expr for name, expr in measures.items()})
    sliced = with_slices(measured, order, n_slices)
    place = [*keys, "_s1", "_s2"]
    totals = sliced.groupBy(*place).agg(*[F.sum(f"_m_{m}").alias(f"_t_{m}") for m in measures])
    before = Window.partitionBy(*keys).orderBy("_s1", "_s2").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *place, *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures]
    )
    inside = (
        Window.partitionBy(*place).orderBy(*sort_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = join_null_safe(sliced, offsets, place)
    out = joined.withColumns(
        {m: F.col(f"_o_{m}") + F.coalesce(F.sum(f"_m_{m}").over(inside), F.lit(0)) for m in measures}
    )
    helpers = ["_s1", "_s2", *[f"_{p}_{m}" for m in measures for p in ("m", "o")]]
    return out.drop(*helpers)


def row_index(
    df: DataFrame,
    keys: list[str],
    order: list[tuple[str, bool]],
    name: str = "row_index",
    n_slices: int | None = None,
) -> DataFrame:
    """1-based position along ``order`` inside each key."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")}, n_slices)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], n_slices: int | None = None
) -> DataFrame:
    """Linear-interpolated quantiles per key, computed from counts of distinct values."""
    from .frames import staged

    # Read several times below, so the counts are written once
    counts = staged(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c")), "counts")
    placed = running_totals(counts, keys, [(value, True)], {"_cum": F.col("_c")}, n_slices)
    if keys:
        sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
        placed = join_null_safe(placed, sizes, keys)
    else:
        placed = placed.withColumn("_n", counts.agg(F.sum("_c")).scalar())
    v, start, end = F.col(value).cast("double"), F.col("_cum") - F.col("_c"), F.col("_cum")
    picks = []
    for name, p in probs.items():
        position = (F.col("_n") - 1) * F.lit(float(p))
        for tag, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            picks.append(F.max(F.when((at >= start) & (at < end), v)).alias(f"_{tag}_{name}"))
    picked = placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    result = []
    for name, p in probs.items():
        position = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        result.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return picked.select(*keys, *result)
