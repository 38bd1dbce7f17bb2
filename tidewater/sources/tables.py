"""Parquet, CSV, JSON-lines and text tables; partitioned sinks and resume."""

from __future__ import annotations

import os
import re
import sys
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tables import upsert
from ..operators.temporal import latest_per_key
from ..plans.frames import staged


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet table; a missing path gives an empty table when a schema is known."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as error:
        if schema is not None and "PATH_NOT_FOUND" in (error.getCondition() or ""):
            return spark.createDataFrame([], schema)
        raise


def read_labelled_windows(spark: SparkSession, path: str) -> DataFrame:
    """Labelled windows and scores from CSV."""
    schema = "window_id STRING, target_date DATE, region STRING, lat DOUBLE, lon DOUBLE, y_true INT, v19_score DOUBLE"
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


class TextFolders(list[str]):
    """Folders on a mounted file system that hold nothing but whole, plain text files."""


def read_text_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole text files as (path, text).

    ``TextFolders`` are listed and read by tasks, a folder at a time. Spark's reader keeps and plans every file in the driver, and sets
    up a Hadoop job of its own for each, which takes far longer than reading a small file.
    """
    if isinstance(path, TextFolders):
        folders = spark.createDataFrame(pa.table({"folder": pa.array(path, pa.string())})).repartition(max(1, len(path)))
        return folders.mapInArrow(_row_per_file, "path string, text binary").withColumn("text", F.col("text").cast("string"))
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text")
    )


# A folder of text files is full at either figure; rows of files leave a task in batches of at most about BATCH_BYTES
FOLDER_FILES, FOLDER_BYTES, BATCH_BYTES = 4096, 64 << 20, 8 << 20
# What Spark escapes in the paths of files
_ESCAPED = r'[\x00-\x20"#%<>?\[\\\]^`{|}\x7f]'


def _row_per_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path and bytes of every file in the folders of a task."""
    rows = lambda paths, texts: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], names=["path", "text"])
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            paths, texts, size = [], [], 0
            # By inode, which is about the order on disk
            for file in sorted(os.scandir(folder.removeprefix("file://")), key=os.DirEntry.inode):
                with open(file.path, "rb", buffering=0) as f:
                    text = f.read()
                if not text:  # Spark's reader leaves empty files out
                    continue
                if texts and size + len(text) > BATCH_BYTES:
                    yield rows(paths, texts)
                    paths, texts, size = [], [], 0
                paths.append("file://" + re.sub(_ESCAPED, lambda m: quote(m[0]), file.path))
                texts.append(text)
                size += len(text)
            if texts:
                yield rows(paths, texts)


def _file_per_row(folder: str, end: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the texts of a task into folders of this attempt, a file each, and gives the folders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders, n, size, last = [], 0, 0, end.encode()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                if not folders or n >= FOLDER_FILES or size >= FOLDER_BYTES:
                    folders.append(os.path.join(folder, uuid.uuid4().hex))
                    os.makedirs(folders[-1])
                    n, size = 0, 0
                rest = text.as_py() + last
                size += len(rest)
                with open(os.path.join(folders[-1], f"{n}.txt"), "wb", buffering=0) as f:
                    while rest:
                        rest = rest[f.write(rest) :]
                n += 1
        if folders:
            yield pa.RecordBatch.from_arrays([pa.array(folders)], names=["folder"])

    return run


def write_text_files(df: DataFrame, text: str, path: str, end: str = "\u0000") -> list[str]:
    """Every text that isn't null as a file of its own, closed by ``end``; the folders to read, of a few thousand files each.

    On a mounted file system tasks write the files themselves. Spark's writer sets the rights of each file by a process of its own
    there, and the driver then moves one file after the other. A folder belongs to one attempt of a task, so those of lost attempts aren't read.
    """
    texts = df.select(F.col(text).cast("string").alias("text")).filter(F.col("text").isNotNull())
    whole = path if ":/" in path else df.sparkSession.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/") + path
    if not whole.startswith("file:"):
        texts.write.option("maxRecordsPerFile", 1).option("lineSep", end).text(path)
        return [path]
    folder = "/" + whole.removeprefix("file:").lstrip("/")
    return TextFolders("file://" + r[0] for r in texts.mapInArrow(_file_per_row(folder, end), "folder string").collect())


def write_by_day(df: DataFrame, path: str, date: str = "date") -> None:
    """Replace only the days present in ``df``; safe to repeat after a lost run."""
    (
        df.hint("rebalance", date).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)
    )


def upsert_partitions(spark: SparkSession, path: str, incoming: DataFrame, key: list[str], order: list[str], partition: str) -> None:
    """Merge ``incoming`` into the table at ``path``, writing just the partitions that its keys hit.

    ``partition`` is a column of the key, so a key never moves. Of several incoming rows of a key the last along ``order`` counts, and
    it replaces the existing one; ``order`` columns need not be in the table. The merged partitions are written beside the table before
    they replace the old ones, so a lost run can be repeated. A missing table is made.
    """
    newest = staged(latest_per_key(incoming, key, order), "incoming")
    try:
        existing = spark.read.parquet(path)
    except AnalysisException:
        existing = newest.limit(0)
    columns = existing.columns
    # As many values as partitions are hit; the scan reads no other
    hit = [r[0] for r in newest.select(partition).distinct().collect()]
    here = F.col(partition).isin([v for v in hit if v is not None])
    old = existing.filter(here | F.col(partition).isNull() if None in hit else here)
    merged = staged(upsert(old, newest.select(columns), key), "merged")
    (
        merged.hint("rebalance", partition).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    )


def days_to_do(wanted: DataFrame, done: DataFrame, date: str = "date") -> DataFrame:
    return wanted.select(date).distinct().join(done.select(date).distinct(), date, "left_anti")


def write_cube(cube: DataFrame, labels: DataFrame, stats: DataFrame, path: str) -> None:
    """Cube and labels partitioned by month, statistics as a small table."""
    month = F.date_format("date", "yyyy-MM").alias("month")
    cube.select("*", month).hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(f"{path}/cube")
    labels.select("*", month).hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(f"{path}/labels")
    stats.write.mode("overwrite").parquet(f"{path}/stats")


def read_cube(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    read = lambda part: spark.read.parquet(f"{path}/{part}")
    return read("cube").drop("month"), read("labels").drop("month"), read("stats")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_per_label(df: DataFrame, path: str, label: str = "label") -> DataFrame:
    """One folder per label plus the summary table."""
    df.write.mode("overwrite").partitionBy(label).parquet(f"{path}/by_label")
    summary = df.groupBy(label).agg(F.count("*").alias("n"))
    summary.write.mode("overwrite").parquet(f"{path}/summary")
    return summary


def freshness(sources: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Newest time and row count per source."""
    whole = None
    for name, (df, time) in sources.items():
        one = df.agg(F.max(time).cast("string").alias("newest"), F.count("*").alias("n")).withColumn("source", F.lit(name))
        whole = one if whole is None else whole.unionByName(one)
    return whole


def feature_documents(df: DataFrame, lon: str, lat: str, properties: list[str], rows_per_document: int = 10_000) -> DataFrame:
    """GeoJSON FeatureCollections of at most about ``rows_per_document`` features each."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"),
    )
    shards = F.ceil(df.select(F.count("*")).scalar() / F.lit(rows_per_document))
    placed = df.withColumn("shard", F.pmod(F.xxhash64(*properties), shards).cast("int"))
    return placed.groupBy("shard").agg(F.collect_list(feature).alias("features")).select(
        "shard", F.size("features").alias("n_features"),
        F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("document"),
    )


# Functions for Python workers travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
