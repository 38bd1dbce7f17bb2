"""Model evaluation and monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..plans.frames import HOT_ROWS, framed, staged
from ..plans.ordering import exact_quantiles, join_null_safe, row_index, running_totals


def regression_error(df: DataFrame, predicted: str, actual: str, keys: list[str] | None = None) -> DataFrame:
    """MAE and RMSE over rows whose target is not ignored."""
    gap = F.col(predicted) - F.col(actual)
    return df.filter(F.col(actual) >= 0).groupBy(*(keys or [])).agg(
        F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.count("*").alias("n_valid")
    )


def _per_score(df: DataFrame, score: str, y: str) -> DataFrame:
    return df.groupBy(score).agg(
        F.sum(F.col(y).cast("bigint")).alias("pos"), F.sum((1 - F.col(y)).cast("bigint")).alias("neg")
    )


def roc_auc(df: DataFrame, score: str, y: str) -> DataFrame:
    """Tie-aware rank statistic from running negative counts; NULL when only one class occurs."""
    placed = running_totals(_per_score(df, score, y), [], [(score, True)], {"neg_below": F.col("neg")})
    wins = F.col("pos") * (F.col("neg_below") - F.col("neg")) + F.col("pos") * F.col("neg") / 2.0
    return placed.agg(
        (F.sum(wins) / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))).alias("auc"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
    )


def average_precision(df: DataFrame, score: str, y: str) -> DataFrame:
    """Precision summed over the recall steps of the distinct thresholds, from the highest score down."""
    counts = _per_score(df, score, y)
    placed = running_totals(counts, [], [(score, False)], {"tp": F.col("pos"), "seen": F.col("pos") + F.col("neg")})
    area = F.sum(F.col("pos") * (F.col("tp") / F.col("seen")))
    return placed.agg(
        F.when(F.sum("neg") > 0, area / F.nullif(F.sum("pos"), F.lit(0))).alias("ap")
    )


def _rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0)),
    }


def f1_at(df: DataFrame, score: str, y: str, threshold: float = 0.5) -> DataFrame:
    hit = F.col(score) >= threshold
    counts = df.agg(
        F.count_if(hit & (F.col(y) == 1)).alias("tp"),
        F.count_if(hit & (F.col(y) == 0)).alias("fp"),
        F.count_if(~hit & (F.col(y) == 1)).alias("fn"),
    )
    return counts.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def guarded_corr(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(
        F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b)).alias("corr")
    )


def latency_stats(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean_ms"), F.count(value).alias("n"))
    p95 = exact_quantiles(df, keys, value, {"p95_ms": 0.95})
    if keys:
        return join_null_safe(means, p95, keys, "left")
    return means.withColumn("p95_ms", p95.scalar())


def rank_normalize(df: DataFrame, score: str, tie: str, name: str) -> DataFrame:
    """Position scaled to [0, 1] in score order, ties in ``tie`` order; 0.5 for a single row."""
    n = df.select(F.count("*")).scalar()
    placed = row_index(df, [], [(score, True), (tie, True)], "_pos")
    return placed.withColumn("_n", n).withColumn(
        name, F.when(F.col("_n") > 1, (F.col("_pos") - 1) / (F.col("_n") - 1)).otherwise(0.5)
    ).drop("_pos", "_n")


def recall100(df: DataFrame, score: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """F1 at the highest threshold that still catches every positive."""
    keys = keys or []
    lowest = df.groupBy(*keys).agg(F.min(F.when(F.col(y) == 1, F.col(score))).alias("threshold"))
    placed = (
        df.join(lowest, keys) if keys else df.withColumn("threshold", lowest.scalar())
    ).filter(F.col("threshold").isNotNull())
    hit = F.col(score) >= F.col("threshold")
    counts = placed.groupBy(*keys, "threshold").agg(
        F.count_if(hit & (F.col(y) == 1)).alias("tp"),
        F.count_if(hit & (F.col(y) == 0)).alias("fp"),
        F.count_if(~hit & (F.col(y) == 1)).alias("fn"),
    )
    return counts.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def alpha_sweep(df: DataFrame, first: str, second: str, y: str, tie: str, steps: int = 10) -> DataFrame:
    """Full-recall F1 for each weight of a two-score rank ensemble, best weight and baseline marked."""
    # The ranks are read twice: for the thresholds of all weights, then for their counts
    ranked = staged(rank_normalize(rank_normalize(df, first, tie, "_r1"), second, tie, "_r2").select(y, "_r1", "_r2"), "ranks")
    alphas = [round(i / steps, 1) for i in range(steps + 1)]
    mix = lambda a: F.lit(a) * F.col("_r1") + (F.lit(1.0) - F.lit(a)) * F.col("_r2")
    lowest = ranked.agg(F.array(*[F.min(F.when(F.col(y) == 1, mix(a))) for a in alphas]).alias("low"))
    marked = ranked.withColumn("_low", lowest.scalar())
    cells = []
    for i, a in enumerate(alphas):
        low = F.get("_low", F.lit(i))
        hit = mix(a) >= low
        cells.append(F.struct(
            F.lit(a).alias("alpha"), F.max(low).alias("threshold"), F.count_if(hit & (F.col(y) == 1)).alias("tp"),
            F.count_if(hit & (F.col(y) == 0)).alias("fp"), F.count_if(~hit & (F.col(y) == 1)).alias("fn"),
        ))
    swept = marked.agg(F.array(*cells).alias("c")).select(F.inline("c")).filter(F.col("threshold").isNotNull())
    rated = swept.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("fn")))
    best = F.max("f1").over(Window.partitionBy(F.lit(0)))  # one row per weight
    return rated.withColumn("is_best", F.col("f1") == best).withColumn("is_baseline", F.col("alpha") == 1.0)


def stage_shares(df: DataFrame, stage: str = "stage", n_stages: int = 5) -> DataFrame:
    """One row with the rounded share of each stage."""
    share = lambda s: round_half_up(F.count_if(F.col(stage) == s) / F.count("*"), 4)
    return df.agg(F.count("*").alias("n"), *[share(s).alias(f"share_{s}") for s in range(n_stages)])


def _drift(shares: list[Column], baseline: list[float], n: Column, min_rows: int) -> Column:
    """Chi-square style distance of shares from a baseline; NULL with too few rows."""
    total = F.lit(0.0)
    for c, b in zip(shares, baseline):
        total = total + F.when(c > 0, c * (c / F.lit(b + 1e-8) + F.lit(1e-8))).otherwise(0.0)
    return F.when(n >= min_rows, F.abs(total - 1.0))


def drift_score(df: DataFrame, baseline: list[float], stage: str = "stage", threshold: float = 0.3, min_rows: int = 30) -> DataFrame:
    """Chi-square style distance of the stage shares from a baseline; NULL with too few rows."""
    shares = stage_shares(df, stage, len(baseline))
    score = _drift([F.col(f"share_{i}") for i in range(len(baseline))], baseline, F.col("n"), min_rows)
    return shares.withColumn("chi2_drift", score).withColumn(
        "is_drift", F.coalesce(F.col("chi2_drift") > threshold, F.lit(False))
    )


def floor_percentiles(df: DataFrame, value: str, percents: list[int]) -> DataFrame:
    """Value at floor(n*p/100) of the sorted values, found from counts of distinct values."""
    counts = df.groupBy(value).agg(F.count("*").alias("_c"))
    placed = running_totals(counts, [], [(value, True)], {"_cum": F.col("_c")}).withColumn(
        "_n", counts.agg(F.sum("_c")).scalar()
    )
    at = lambda p: F.least(F.floor(F.col("_n") * F.lit(p) / 100), F.col("_n") - 1)
    here = lambda p: (at(p) >= F.col("_cum") - F.col("_c")) & (at(p) < F.col("_cum"))
    return placed.agg(*[F.max(F.when(here(p), F.col(value))).alias(f"p{p}") for p in percents])


def perf_summary(df: DataFrame, latency: str, score: str) -> DataFrame:
    """Monitor summary: latency mean and floor-index percentiles, score moments."""
    spread = F.coalesce(F.stddev_samp(score), F.lit(0.0))
    base = df.agg(
        F.count("*").alias("n"), F.avg(latency).alias("latency_mean"), F.avg(score).alias("score_mean"),
        spread.alias("score_stdev"), F.min(score).alias("score_min"), F.max(score).alias("score_max"),
    )
    marks = floor_percentiles(df, latency, [50, 95, 99])
    return base.withColumns({f"latency_p{p}": marks.select(f"p{p}").scalar() for p in (50, 95, 99)})


#: Rows of a key that one task takes: every row sorts its window, so a key of many rows is cut early
ROLLING_ROWS = 200_000


def perf_rolling(
    df: DataFrame, keys: list[str], order: list[tuple[str, bool]], latency: str, score: str, window: int = 200, hot_rows: int = ROLLING_ROWS,
    stage: str | None = None, baseline: list[float] | None = None, threshold: float = 0.3, min_rows: int = 30,
) -> DataFrame:
    """Trailing-window monitor statistics at every inference; with ``stage`` and ``baseline`` also the window's drift."""

    def measure(part: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*[F.col(c) for c, _ in order]).rowsBetween(-(window - 1), 0)
        out = part.withColumns(
            {
                "win_n": F.count("*").over(w),
                "latency_mean": F.avg(latency).over(w),
                "score_mean": F.avg(score).over(w),
                "score_stdev": F.coalesce(F.stddev_samp(score).over(w), F.lit(0.0)),
                "score_min": F.min(score).over(w),
                "score_max": F.max(score).over(w),
                "_sorted": F.array_sort(F.collect_list(latency).over(w)),
            }
        )
        at = lambda p: F.element_at(
            "_sorted", F.least(F.floor(F.col("win_n") * F.lit(p) / 100), F.col("win_n") - 1).cast("int") + 1
        )
        out = out.withColumns({f"latency_p{p}": at(p) for p in (50, 95, 99)}).drop("_sorted")
        if stage is None or not baseline:
            return out
        counted = out.withColumns({f"_in_{s}": F.count_if(F.col(stage) == s).over(w) for s in range(len(baseline))})
        return with_drift(counted, baseline, threshold, min_rows)

    return framed(df, keys, order, measure, preceding=window - 1, hot_rows=hot_rows)


def with_drift(counted: DataFrame, baseline: list[float], threshold: float = 0.3, min_rows: int = 30) -> DataFrame:
    """Drift of windows from their rows ``win_n`` and the rows per stage ``_in_0``, ``_in_1`` and so on, which are dropped."""
    inside = [f"_in_{s}" for s in range(len(baseline))]
    shares = [round_half_up(F.col(c) / F.col("win_n"), 4) for c in inside]
    scored = counted.withColumn("chi2_drift", _drift(shares, baseline, F.col("win_n"), min_rows)).drop(*inside)
    return scored.withColumn("is_drift", F.coalesce(F.col("chi2_drift") > threshold, F.lit(False)))


def paired_diff(a: DataFrame, b: DataFrame, key: str, score: str) -> DataFrame:
    """Mean, maximum and 95th percentile of the absolute difference of two score tables."""
    gaps = a.select(key, F.col(score).alias("_a")).join(b.select(key, F.col(score).alias("_b")), key).select(
        F.abs(F.col("_a") - F.col("_b")).alias("gap")
    )
    p95 = exact_quantiles(gaps, [], "gap", {"p95": 0.95}).scalar()
    return gaps.agg(
        F.count("*").alias("n"), F.avg("gap").alias("mean_diff"), F.max("gap").alias("max_diff")
    ).withColumn("p95_diff", p95)


def metric_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two metric tables (metric, value) with the difference where both are known."""
    left = a.select("metric", F.col("value").alias("value_a"))
    right = b.select("metric", F.col("value").alias("value_b"))
    return left.join(right, "metric", "full").withColumn("delta", F.col("value_b") - F.col("value_a"))


def permutation_importance(
    df: DataFrame, key: str, columns: list[str], shuffle_key: Column, score, y: str, threshold: float
) -> DataFrame:
    """F1 drop when one column is permuted; all columns are shuffled in one job.

    ``shuffle_key`` orders the donor rows; row i receives the value of the donor at position i. ``score`` maps a
    column-name -> Column dict to a score column.
    """
    base = row_index(df, [], [(key, True)], "_pos")
    donors = row_index(df.withColumn("_h", shuffle_key), [], [("_h", True), (key, True)], "_pos").select(
        "_pos", *[F.col(c).alias(f"_d_{c}") for c in columns]
    )
    paired = base.join(donors, "_pos")
    variants = F.explode(F.array(F.lit("baseline"), *[F.lit(c) for c in columns]))
    stacked = paired.withColumn("feature", variants)
    used = {c: F.when(F.col("feature") == c, F.col(f"_d_{c}")).otherwise(F.col(c)) for c in columns}
    hit = score(used) >= threshold
    counts = stacked.groupBy("feature").agg(
        F.count_if(hit & (F.col(y) == 1)).alias("tp"),
        F.count_if(hit & (F.col(y) == 0)).alias("fp"),
        F.count_if(~hit & (F.col(y) == 1)).alias("fn"),
    )
    rated = counts.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("fn"))).select("feature", "f1")
    whole = rated.filter(F.col("feature") == "baseline").select("f1").scalar()
    return rated.withColumn("drop", whole - F.col("f1"))
