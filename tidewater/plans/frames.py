"""Bounded-frame windows over keys of any size, calendars and staging."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ordering import join_null_safe, row_index

HOT_ROWS = 5_000_000


def framed(
    df: DataFrame,
    keys: list[str],
    order: list[tuple[str, bool]],
    apply: Callable[[DataFrame, list[str]], DataFrame],
    preceding: int = 0,
    following: int = 0,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Run ``apply(df, partition_columns)``, whose frames reach at most ``preceding`` /
    ``following`` rows, without giving a very large key to one task.

    Keys above ``hot_rows`` rows are cut into blocks by row position; each block also
    receives the neighbouring rows its frames need, and those helper rows are dropped again.
    """
    hot = df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > hot_rows).drop("_rows")
    if hot.isEmpty():
        return apply(df, keys)
    cold = apply(join_null_safe(df, hot, keys, "left_anti"), keys)
    block = max(hot_rows, preceding, following, 1)
    placed = row_index(join_null_safe(df, hot, keys, "left_semi"), keys, order, "_pos")
    home = F.floor((F.col("_pos") - 1) / F.lit(block))
    offset = (F.col("_pos") - 1) % F.lit(block)
    copies = F.array_compact(
        F.array(
            home,
            F.when(offset >= block - preceding, home + 1),
            F.when((offset < following) & (home > 0), home - 1),
        )
    )
    spread = placed.withColumn("_home", home).withColumn("_block", F.explode(copies))
    done = apply(spread, [*keys, "_block"]).filter(F.col("_block") == F.col("_home"))
    return cold.unionByName(done.drop("_home", "_block", "_pos"))


def calendar(df: DataFrame, entity: list[str], date: str = "date") -> DataFrame:
    """Every (entity, date) pair for the dates that occur anywhere in ``df``.

    The distinct dates are one array, bounded by the calendar; a stray date costs one row per entity.
    """
    days = df.select(F.collect_set(date)).scalar()
    return df.select(*entity).distinct().withColumn(date, F.explode(days)).select(*entity, date)


def staging_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: the cluster's checkpoint folder. Only a local session without one gets a temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = os.path.join(tempfile.gettempdir(), "tidewater-staging")
        spark.sparkContext.setCheckpointDir(configured)
        configured = spark.sparkContext.getCheckpointDir()
    return configured.rstrip("/")


def staging_path(spark: SparkSession, label: str) -> str:
    return f"{staging_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the staging folder and read it back."""
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
