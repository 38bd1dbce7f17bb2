"""Streaming operators T1-T11; each starts a query over a stream and names where its result lands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed_values as fx
from ..functions import seasons
from ..operators.evaluation import with_drift
from ..operators.quality import raised_flags
from ..operators.reports import alert_feed
from .carry import Carry, start_updates, start_with_carry
from .processors import DeficitIndex, FillAndCount, MonitorWindow, Ring, SlidingLog, WindowStatistics

#: Needed by T2-T4, T6, T10 and T11
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"


def _ddl(df: DataFrame, without: tuple[str, ...] = ()) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without)


def _appended(df: DataFrame, path: str) -> StreamingQuery:
    return start_updates(df, path, "append")


def dedup(stream: DataFrame, keys: list[str], time: str, path: str, delay: str = "2 days") -> StreamingQuery:
    """Each (key, time) once; rows already landed by an earlier run are skipped as well."""
    once = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, time])

    def land(batch: DataFrame, before: DataFrame | None) -> tuple[DataFrame, Carry]:
        fresh = batch if before is None else batch.join(before, [*keys, time], "left_anti")
        seen = batch.select(*keys, time)
        # The newest time of batch and carry, so that a batch without rows keeps the carry
        kept = seen if before is None else seen.unionByName(before).distinct()
        newest = kept.select(F.max(time)).scalar()
        return fresh, kept.filter(F.col(time) >= newest - F.expr(f"INTERVAL {delay}"))

    return start_with_carry(once, land, path)


def outliers(stream: DataFrame, keys: list[str], order: list[str], path: str, window: int = 50) -> StreamingQuery:
    """The batch detector's flags, the last ``window`` readings of each key being kept in the state store."""
    present = stream.filter(F.col("value").isNotNull())
    processor = WindowStatistics(["value"], order, window)
    stats = present.groupBy(*keys).transformWithStateInPandas(processor, f"{_ddl(present)}, {processor.ADDED}", "Append", "None")
    return _appended(raised_flags(stats), path)


def deficit_index(stream: DataFrame, cell: list[str], path: str) -> StreamingQuery:
    """The deficit index of each cell, begun anew each season.

    ``stream`` has ``date``, ``din`` and ``weight``; a day's weight depends on the whole domain and so comes with the rows.
    """
    days = stream.filter(seasons.in_season(F.col("date"))).select(
        *cell, "date", seasons.season_id(F.col("date")).cast("int").alias("season"), F.col("din").cast("double"), F.col("weight").cast("double")
    )
    processor = DeficitIndex(fx.DIN_DEFICIT_UGL, fx.ADI_DECAY, fx.ADI_CEILING)
    return _appended(
        days.groupBy(*cell).transformWithStateInPandas(processor, f"{_ddl(days, ('din', 'weight'))}, adi DOUBLE", "Append", "None"), path
    )


def monitor(
    stream: DataFrame, keys: list[str], order: list[str], latency: str, score: str, path: str, window: int = 200,
    stage: str | None = None, baseline: list[float] | None = None,
) -> StreamingQuery:
    """T4: trailing-window statistics and drift, the window spanning micro-batches."""
    stages = len(baseline) if stage and baseline else 0
    processor = MonitorWindow([latency, score, *([stage] if stages else [])], order, window - 1, stages)
    plain = ["latency_mean", "score_mean", "score_stdev", "score_min", "score_max", "latency_p50", "latency_p95", "latency_p99"]
    added = ["win_n BIGINT", *[f"{c} DOUBLE" for c in plain], *[f"_in_{i} BIGINT" for i in range(stages)]]
    stats = stream.groupBy(*keys).transformWithStateInPandas(processor, f"{_ddl(stream)}, {', '.join(added)}", "Append", "None")
    return _appended(with_drift(stats, baseline) if stages else stats, path)


def latest(stream: DataFrame, keys: list[str], order: list[str], path: str, seconds: int | None = None) -> StreamingQuery:
    """T5: newest row per key in update mode; ``seconds`` sets the refresh of a continuous run."""
    rest = [c for c in stream.columns if c not in keys and c not in order]
    newest = stream.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_m")).select(*keys, "_m.*")
    return start_updates(newest, path, trigger={"processingTime": f"{seconds} seconds"} if seconds else None)


def rate_limit(
    stream: DataFrame, keys: list[str], path: str, seconds: int = fx.RATE_WINDOW_SECONDS, time: str | None = None, delay: str = "1 day"
) -> StreamingQuery:
    """Only requests that were let through count against the limit.

    ``stream`` has ``event_id``, ``micros`` and ``limit``; state per key is at most ``limit`` times. The result has allowed, remaining,
    reset_at and, where denied, retry_after, both in seconds. With the event time column ``time`` a timer clears the state of a key
    once the watermark, ``delay`` behind the newest row, has passed its window, and rows behind the watermark are dropped.
    """
    schema = "event_id BIGINT, allowed BOOLEAN, remaining BIGINT, reset_at BIGINT, retry_after BIGINT"
    seen = stream.withWatermark(time, delay) if time else stream
    decided = seen.groupBy(*keys).transformWithState(
        SlidingLog(seconds * 1_000_000, bool(time)), schema, "Append", "EventTime" if time else "None"
    )
    return _appended(decided, path)


def running_statistics(stream: DataFrame, channel: str, value: str, path: str) -> StreamingQuery:
    """Merged moments per channel, complete mode."""
    v = F.col(value)
    sums = stream.groupBy(channel).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    return start_updates(
        sums.select(channel, "n", "mean", F.greatest("sd", F.lit(1e-8)).alias("std"), "min", "max"), path, "complete"
    )


def daily_composite(stream: DataFrame, time: str, cell: list[str], value: str, path: str, delay: str = "1 day") -> StreamingQuery:
    """Exact median per (day, cell) in a tumbling window; the state is one cell's values of one day."""
    daily = stream.withWatermark(time, delay).groupBy(F.window(time, "1 day"), *cell).agg(F.median(value).alias("value"))
    return start_updates(daily.select(F.col("window.start").cast("date").alias("date"), *cell, "value"), path)


def rain_24h(stream: DataFrame, time: str, keys: list[str], value: str, path: str, delay: str = "2 days") -> StreamingQuery:
    """Trailing-24-hour sums, one result per hour."""
    sums = stream.withWatermark(time, delay).groupBy(F.window(time, "24 hours", "1 hour"), *keys).agg(F.sum(value).alias("total"))
    return start_updates(sums.select(F.col("window.end").alias("window_end"), *keys, "total"), path)


def fill_and_count(stream: DataFrame, cell: list[str], value: str, rain: str, path: str, wet: float = 0.5) -> StreamingQuery:
    """Forward fill and the dry-spell counter, both continued from the last day of each cell."""
    rows = stream.select(*cell, "date", F.col(value).cast("double").alias(value), F.col(rain).cast("double").alias(rain))
    schema = f"{_ddl(rows, (value, rain))}, value DOUBLE, dry BIGINT"
    return _appended(rows.groupBy(*cell).transformWithStateInPandas(FillAndCount(value, rain, wet), schema, "Append", "None"), path)


def alerts(
    stream: DataFrame, time: str, tie: str, severity: str, path: str, recent: int = 60, shown: int = 20, shards: int = 64
) -> StreamingQuery:
    """The alert list after each micro-batch, from the newest ``recent`` readings so far.

    Rings by shard come first, and just what is new in them reaches the one ring of all, so this holds few rows however large a batch.
    """
    rows = stream.select(F.unix_micros(F.col(time).cast("timestamp")).alias("micros"), F.col(tie).alias("tie"), F.col(severity).alias("severity"))
    schema, order = rows.schema, ["micros", "tie"]
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("tie"), F.lit(shards))).groupBy("shard").transformWithStateInPandas(
        Ring(schema, order, recent, True), schema, "Append", "None"
    )
    ring = sharded.withColumn("whole", F.lit(0)).groupBy("whole").transformWithStateInPandas(Ring(schema, order, recent, False), schema, "Append", "None")

    def listed(batch: DataFrame) -> DataFrame:
        feed = alert_feed(batch, order, "severity", recent, shown)
        return feed.select(F.timestamp_micros("micros").alias(time), F.col("tie").alias(tie), F.col("severity").alias(severity), "alert_no")

    return start_updates(ring, path, "append", finish=listed)


def late_rows(stream: DataFrame, time: str, keys: list[str], path: str, delay: str = "1 day") -> StreamingQuery:
    """Rows once per key within the watermark, as T1, and how many came too late.

    A row whose time is not after the watermark is dropped; every micro-batch's number of rows and of dropped ones is reported by the
    engine, and ``late_counts`` reads it from the query when it has ended.
    """
    once = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    return _appended(once, path)


def late_counts(spark: SparkSession, job: StreamingQuery) -> DataFrame:
    """(batch, n_rows, n_late) of an ended query with row-wise state, one row per micro-batch that had rows."""
    seen = [
        (int(p.batchId), int(p.numInputRows), sum(int(o.numRowsDroppedByWatermark) for o in p.stateOperators))
        for p in job.recentProgress if p.numInputRows
    ]
    return spark.createDataFrame(seen, "batch BIGINT, n_rows BIGINT, n_late BIGINT")
