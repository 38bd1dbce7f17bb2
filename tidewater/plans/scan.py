"""Accumulations along an order as an associative scan, so that one key's history is split over tasks.

A step ``state -> least(c, a * state + b)`` with a >= 0 is a clamped affine function, and two of them in a row are one again. The rows
of a key are cut into short stretches of their order. Each stretch is composed to one function, the stretches of a key are
scanned in the same way, and every stretch then walks its own rows from the state that it begins with.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import staged
from .ordering import join_null_safe

#: Positions of one stretch; a stretch is walked in one task
STRETCH = 64

_FUNCTION = "struct<a:double,b:double,c:double>"


def affine(a: Column | float, b: Column | float, c: Column | float = math.inf) -> Column:
    """The step ``least(c, a * state + b)``."""
    as_double = lambda x: (x if isinstance(x, Column) else F.lit(float(x))).cast("double")
    return F.struct(as_double(a).alias("a"), as_double(b).alias("b"), as_double(c).alias("c"))


def _identity() -> Column:
    return affine(1.0, 0.0)


def applied(step: Column, state: Column) -> Column:
    return F.least(step["c"], step["a"] * state + step["b"])


def _then(first: Column, second: Column) -> Column:
    """First ``first``, then ``second``; a step that forgets the state is not asked what it was."""
    most = F.when(second["a"] == 0, second["c"]).otherwise(F.least(second["c"], second["a"] * first["c"] + second["b"]))
    return F.struct((second["a"] * first["a"]).alias("a"), (second["a"] * first["b"] + second["b"]).alias("b"), most.alias("c"))


def _before(stretches: DataFrame, keys: list[str], span: int) -> DataFrame:
    """(keys, _at, _f): what all earlier stretches of the key do to a state. ``span`` bounds the stretch numbers of a key."""
    packs = stretches.withColumn("_up", F.floor(F.col("_at") / STRETCH)).groupBy(*keys, "_up").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_f"))).alias("_s"))

    def step(state: Column, x: Column) -> Column:
        entry = F.struct(x["_at"].alias("_at"), state["f"].alias("_f"))
        return F.struct(_then(state["f"], x["_f"]).alias("f"), F.concat(state["path"], F.array(entry)).alias("path"))

    start = F.struct(_identity().alias("f"), F.array().cast(f"array<struct<_at:bigint,_f:{_FUNCTION}>>").alias("path"))
    walked = packs.select(*keys, "_up", F.aggregate("_s", start, step).alias("_w"))
    if span <= STRETCH:
        return walked.select(*keys, F.inline("_w.path"))
    walked = staged(walked, "stretches")  # read for the functions and for the rows
    above = _before(walked.select(*keys, F.col("_up").alias("_at"), F.col("_w.f").alias("_f")), keys, -(-span // STRETCH))
    inside = walked.select(*keys, F.col("_up").alias("_at"), F.col("_w.path").alias("_path"))
    each = join_null_safe(inside, above, [*keys, "_at"]).select(*keys, F.col("_f").alias("_outer"), F.inline("_path"))
    return each.select(*keys, "_at", _then(F.col("_outer"), F.col("_f")).alias("_f"))


def accumulate(df: DataFrame, keys: list[str], position: str, step: Column, name: str, start: Column | None = None) -> DataFrame:
    """The rows with the state after each of them in column ``name``.

    ``position`` is an integer column that orders the rows of a key, without repeats; it may have gaps. ``step`` is made by ``affine``.
    The state begins at 0, or at ``start``, which must be the same for all rows of a key. Null keys are a group of their own.
    Times are linear in the rows, and stretches of a key are spread over tasks.
    """
    kept = df.columns
    rows = df.withColumns({"_p": F.col(position).cast("bigint"), "_step": step, "_start": (start if start is not None else F.lit(0.0)).cast("double")})
    low, high = rows.agg(F.min("_p"), F.max("_p")).first()
    span = 1 if low is None else (high - low) // STRETCH + 1
    low = low or 0
    placed = rows.withColumn("_at", F.floor((F.col("_p") - low) / STRETCH).cast("bigint"))
    entry = F.struct("_p", "_step", F.struct(*kept).alias("_row"))
    packs = placed.groupBy(*keys, "_at").agg(F.array_sort(F.collect_list(entry), lambda x, y: F.when(x["_p"] < y["_p"], -1).when(x["_p"] > y["_p"], 1).otherwise(0)).alias("_s"), F.first("_start").alias("_start"))
    packs = staged(packs, "packs")  # read for the functions and for the rows
    whole = packs.select(*keys, "_at", F.aggregate("_s", _identity(), lambda f, x: _then(f, x["_step"])).alias("_f"))
    begun = join_null_safe(packs, _before(whole, keys, span), [*keys, "_at"])

    def walk(state: Column, x: Column) -> Column:
        now = applied(x["_step"], state["now"])
        return F.struct(now.alias("now"), F.concat(state["path"], F.array(now)).alias("path"))

    first = F.struct(applied(F.col("_f"), F.col("_start")).alias("now"), F.array().cast("array<double>").alias("path"))
    states = F.aggregate("_s", first, walk, lambda s: s["path"])
    each = begun.select(F.explode(F.arrays_zip(F.transform("_s", lambda x: x["_row"]).alias("row"), states.alias("state"))).alias("_e"))
    return each.select(*[F.col(f"_e.row.`{c}`").alias(c) for c in kept], F.col("_e.state").alias(name))
