"""Prediction packs: merge, coverage, classification, sequences and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions import seasons
from ..functions.numeric import clamp, lookup, round_half_up
from ..functions.risk import warn_class
from ..plans.frames import calendar
from .temporal import first_per_key, previous_date


def merge_packs(packs: list[DataFrame]) -> DataFrame:
    """Union of packs where a later pack replaces an earlier entry of the same (date, gid)."""
    ranked = [p.withColumn("_rank", F.lit(-i)) for i, p in enumerate(packs)]
    whole = ranked[0]
    for p in ranked[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return first_per_key(whole, ["date", "gid"], ["_rank"]).drop("_rank")


def no_coverage(pack: DataFrame, out_of_grid: DataFrame) -> DataFrame:
    """Farms whose index never rose above zero, plus the farms outside the grid."""
    peak = F.max(F.coalesce(F.array_max("adi7"), F.lit(0.0)))
    silent = pack.groupBy("gid").agg(peak.alias("_peak")).filter(F.col("_peak") <= 0).select("gid")
    return silent.union(out_of_grid.select("gid")).distinct()


def coverage_alarm(pack: DataFrame, masked: DataFrame, limit: float = 0.9) -> DataFrame:
    """Masked share of all farms and whether it points at a broken pack schema."""
    farms = pack.agg(F.count_distinct("gid").alias("n_farms"))
    n_masked = masked.agg(F.count("*")).scalar()
    return farms.withColumn("n_masked", n_masked).withColumn(
        "schema_alarm", (F.col("n_farms") > 0) & (F.col("n_masked") / F.col("n_farms") > limit)
    )


def onset_delta(pack: DataFrame, max_gap: int = 3) -> DataFrame:
    """Change of ``warn`` against the previous pack date, if that date is close enough."""
    dated = pack.join(previous_date(pack, "date", max_gap), "date")
    before = pack.select(F.col("gid"), F.col("date").alias("prev_date"), F.col("warn").alias("warn_prev"))
    return dated.join(before, ["gid", "prev_date"], "left").withColumn(
        "onset", round_half_up(F.col("warn") - F.col("warn_prev"), 4)
    )


def classify_pack(pack: DataFrame, masked: DataFrame) -> DataFrame:
    """In-season entries with risk class, labels and onset; masked farms get no class."""
    flagged = onset_delta(pack).filter(seasons.in_season(F.col("date"))).join(
        masked.select("gid", F.lit(True).alias("no_coverage")), "gid", "left"
    )
    covered = F.col("no_coverage").isNull()
    risk = F.when(covered, warn_class(F.coalesce(F.col("warn"), F.lit(0.0))))
    return flagged.withColumns(
        {
            "risk": risk,
            "risk_label": F.when(covered, lookup(risk, fx.RISK_LABELS)).otherwise(fx.NO_COVERAGE_LABEL),
            "stage_label": F.coalesce(lookup(F.col("stage"), fx.PACK_STAGE_LABELS), F.lit("??")),
            "warn_prev": F.when(covered, F.col("warn_prev")),
            "onset": F.when(covered, F.col("onset")),
            "no_coverage": F.coalesce(F.col("no_coverage"), F.lit(False)),
        }
    )


def risk_counts(classified: DataFrame) -> DataFrame:
    bucket = F.when(F.col("no_coverage"), "no_coverage").otherwise(F.coalesce(F.col("risk"), F.lit("unknown")))
    return classified.groupBy("date", bucket.alias("risk")).agg(F.count("*").alias("n"))


def risk_sequence(pack: DataFrame, masked: DataFrame) -> DataFrame:
    """One code per in-season date and farm, '.' where there is no usable entry.

    Each string is as long as the calendar, so the per-farm list is bounded by days.
    """
    entries = pack.filter(seasons.in_season(F.col("date")))
    code = lookup(warn_class(F.coalesce(F.col("warn"), F.lit(0.0))), fx.RISK_CODES)
    coded = entries.join(masked, "gid", "left_anti").select("gid", "date", code.alias("code"))
    dense = calendar(entries, ["gid"]).join(coded, ["gid", "date"], "left")
    ordered = F.array_sort(F.collect_list(F.struct("date", F.coalesce("code", F.lit(".")).alias("code"))))
    return dense.groupBy("gid").agg(
        F.array_join(F.transform(ordered, lambda e: e.code), "").alias("codes")
    )


def season_summary(pack: DataFrame, today: Column) -> DataFrame:
    """Whether ``today`` is in season, and the pack's in-season dates."""
    days = pack.select("date").distinct().filter(seasons.in_season(F.col("date")))
    return days.agg(
        F.count("*").alias("n_in_season_dates"), F.max("date").alias("latest_in_season_date")
    ).withColumn("today_in_season", seasons.in_season(today))


def pack_lookup(pack: DataFrame, date: Column | None = None) -> DataFrame:
    """Complete entries of one date, by default the newest date of the pack."""
    wanted = pack.select(F.max("date")).scalar() if date is None else date
    return pack.filter(
        (F.col("date") == wanted) & F.col("stage").isNotNull() & (F.size(F.coalesce("adi7", F.array())) > 0)
    )


def forecast(entries: DataFrame) -> DataFrame:
    """Horizon days as rows with the scaled index."""
    return entries.select("*", F.posexplode("adi7").alias("_pos", "adi")).withColumns(
        {"day": F.col("_pos") + 1, "wbi": round_half_up(clamp(F.col("adi") / 10.0, 0.0, 1.0), 3)}
    ).drop("_pos")


def forecast_peak(entries: DataFrame) -> DataFrame:
    """First day of the highest scaled index per entry, from the entry's own array."""
    wbi = F.transform("adi7", lambda a: round_half_up(clamp(a / 10.0, 0.0, 1.0), 3))
    return entries.withColumn("_w", wbi).withColumns(
        {
            "current_wbi": F.col("_w")[0],
            "horizon_days": F.size("_w"),
            "peak_wbi": F.array_max("_w"),
            "peak_day": F.array_position("_w", F.array_max("_w")),
        }
    ).drop("_w")


def farm_series(pack: DataFrame, masked: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Dated entries per farm within optional bounds, with the coverage flag."""
    kept = pack
    if start is not None:
        kept = kept.filter(F.col("date") >= start)
    if end is not None:
        kept = kept.filter(F.col("date") <= end)
    return kept.join(masked.select("gid", F.lit(True).alias("no_coverage")), "gid", "left").withColumn(
        "no_coverage", F.coalesce("no_coverage", F.lit(False))
    )


def pack_documents(pack: DataFrame, farms_per_document: int = 20_000, bare_stage: bool = False) -> DataFrame:
    """Pack JSON documents ``{date: {gid: entry}}``; a large date is spread over several documents.

    The number of documents per date follows from that date's farm count, so no document grows without bound, and
    readers merge documents of one date. ``bare_stage`` writes the older form, where an entry is just its stage.
    """
    sizes = pack.groupBy("date").agg(F.count("*").alias("_n"))
    parts = F.ceil(F.col("_n") / F.lit(farms_per_document))
    placed = pack.join(sizes, "date").withColumn("part", F.pmod(F.xxhash64("gid"), parts).cast("int"))
    fields = [c for c in ("stage", "warn", "severe", "adi7") if c in pack.columns]
    entry = F.struct(F.col("gid").cast("string"), F.col("stage") if bare_stage else F.struct(*fields))
    farms = F.map_from_entries(F.array_sort(F.collect_list(entry)))
    return (
        placed.groupBy("date", "part")
        .agg(farms.alias("_farms"), F.count("*").alias("n_farms"))
        .select(
            "date", "part", "n_farms",
            F.to_json(F.create_map(F.col("date").cast("string"), F.col("_farms"))).alias("document"),
        )
    )
