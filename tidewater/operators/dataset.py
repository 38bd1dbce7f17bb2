"""Training-set preparation: windows, starts, splits, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.frames import staged
from ..plans.ordering import exact_quantiles, join_null_safe, row_index
from ..plans.scan import accumulate, affine


def number_days(days: DataFrame, date: str = "date") -> DataFrame:
    """Zero-based step per date. The input has one row per date, so the window is bounded by the calendar."""
    return days.withColumn("t", F.row_number().over(Window.orderBy(date)) - 1)


def future_max(df: DataFrame, keys: list[str], value: str, t_in: int = 24, t_out: int = 7) -> DataFrame:
    """Maximum over rows t+t_in .. t+t_in+t_out-1 of each key."""
    ahead = Window.partitionBy(*keys).orderBy("date").rowsBetween(t_in, t_in + t_out - 1)
    return df.withColumn("future_max", F.max(value).over(ahead))


def window_labels_area(fractions: DataFrame, t_in: int = 24, t_out: int = 7, share: float = 0.01) -> DataFrame:
    """Window label per start from daily area shares: highest stage whose future maximum reaches ``share``."""
    steps = number_days(fractions)
    ahead = Window.orderBy("t").rowsBetween(t_in, t_in + t_out - 1)
    top = lambda c: F.max(c).over(ahead)
    label = (
        F.when(top("valid_cells") == 0, -1)
        .when(top("frac_3") >= share, 3)
        .when(top("frac_2") >= share, 2)
        .when(top("frac_1") >= share, 1)
        .otherwise(0)
    )
    n = steps.select(F.count("*")).scalar()
    return steps.select("t", "date", label.alias("label")).filter(F.col("t") <= n - t_in - t_out)


def window_starts(labelled: DataFrame, stride: int = 6) -> DataFrame:
    """Every start of an abnormal window, every ``stride``-th normal one, no ignored ones."""
    return labelled.filter((F.col("label") > 0) | ((F.col("label") == 0) & (F.col("t") % stride == 0)))


def sliding_windows(
    series: DataFrame, keys: list[str], features: list[str], target: str, t_in: int = 24, t_out: int = 7
) -> DataFrame:
    """Input and target arrays per full window; every array is bounded by the window length."""
    order = Window.partitionBy(*keys).orderBy("date")
    back = order.rowsBetween(0, t_in - 1)
    ahead = order.rowsBetween(t_in, t_in + t_out - 1)
    return (
        series.withColumn("x", F.collect_list(F.struct(*features)).over(back))
        .withColumn("y", F.collect_list(F.struct(F.col(target).alias("v"))).over(ahead))
        .filter((F.size("x") == t_in) & (F.size("y") == t_out))
        .withColumn("y", F.transform("y", lambda s: s.v))
    )


def stratified_split(starts: DataFrame, label: str = "label", val_ratio: float = 0.2) -> DataFrame:
    """First part of each label's starts to train, the rest to val."""
    starts = staged(starts, "starts")  # at most one row per day, read several times below
    placed = row_index(starts, [label], [("t", True)], "_pos")
    sizes = starts.groupBy(label).agg(F.count("*").alias("_n"))
    cut = F.floor(F.col("_n") * (1 - val_ratio) + F.lit(1e-9))
    return (
        join_null_safe(placed, sizes, [label])
        .withColumn("split", F.when(F.col("_pos") <= cut, "train").otherwise("val"))
        .drop("_pos", "_n")
    )


def episode_holdout(starts: DataFrame, boundary: Column, span: int = 31) -> DataFrame:
    """Windows that end before the boundary train, windows that start after it validate, the rest is purged."""
    return starts.withColumn(
        "split",
        F.when(F.col("t") + span <= boundary, "train").when(F.col("t") >= boundary, "val").otherwise("purge"),
    )


def oversample_minor(split: DataFrame, times: int = 3, label: str = "label") -> DataFrame:
    """Repeat the minority labels of the training part."""
    minor = F.col(label).isin(1, 2, 3) & (F.col("split") == "train")
    copies = F.when(minor, F.lit(times)).otherwise(F.lit(1))
    return split.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))


def split_leakage(split: DataFrame, span: int = 31) -> DataFrame:
    """Steps covered by both a train and a val window."""
    covered = lambda s: split.filter(F.col("split") == s).select(
        F.explode(F.sequence(F.col("t"), F.col("t") + (span - 1))).alias("t")
    )
    return covered("train").intersect(covered("val"))


def patch_cells(cells: DataFrame, anchors: list[tuple[int, int]], size: int) -> DataFrame:
    """Cells of each square patch, with their position inside the patch."""
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("row_idx").between(r, r + size - 1) & F.col("col_idx").between(c, c + size - 1),
                    F.struct(
                        F.lit(i).alias("patch_id"),
                        (F.col("row_idx") - r).alias("patch_row"),
                        (F.col("col_idx") - c).alias("patch_col"),
                    ),
                )
                for i, (r, c) in enumerate(anchors)
            ]
        )
    )
    return cells.select("*", F.inline(hits))


def quantile_bins(df: DataFrame, value: str, probs: list[float], name: str = "bin") -> DataFrame:
    """Class number = how many quantile cut points the value reaches."""
    cuts = exact_quantiles(df, [], value, {f"q{i}": p for i, p in enumerate(probs)})
    number = F.lit(0)
    for i in range(len(probs)):
        number = number + (F.col(value) >= cuts.select(f"q{i}").scalar()).cast("int")
    return df.withColumn(name, number)


def ema_accumulate(series: DataFrame, keys: list[str], value: str, alpha: float = 0.3) -> DataFrame:
    """(keys, date, ema): exponential moving accumulation along dates, one row per (key, date).

    The first value of a key is taken as it is; a missing value leaves the accumulation where it was.
    """
    begun = series.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min("date").alias("_first"))
    rows = join_null_safe(series.select(*keys, "date", F.col(value).alias("_v")), begun, keys, "left").withColumn("_day", F.unix_date("date"))
    first = F.col("date") == F.col("_first")
    keep = F.when(F.col("_v").isNull(), 1.0).when(first, 0.0).otherwise(1 - alpha)
    add = F.when(F.col("_v").isNull(), 0.0).when(first, F.col("_v")).otherwise(F.lit(alpha) * F.col("_v"))
    walked = accumulate(rows, keys, "_day", affine(keep, add), "ema")
    return walked.select(*keys, "date", F.when(F.col("date") >= F.col("_first"), F.col("ema")).alias("ema"))


def hash_split(df: DataFrame, bucket: Column, train_pct: int = 80) -> DataFrame:
    """Deterministic random split from a 0..99 hash bucket."""
    return df.withColumn("split", F.when(bucket < train_pct, "train").otherwise("val"))


def sample_per_label(df: DataFrame, label: str, order: list[Column], n: int) -> DataFrame:
    """``n`` pseudo-random rows per label; the row limit is applied before the shuffle."""
    w = Window.partitionBy(label).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")
