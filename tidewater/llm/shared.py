"""Helpers that several of the training-data operators use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below the cluster's shared checkpoint folder. Only a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: str) -> Column:
    """The column's text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def per_row(
    df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]
) -> DataFrame:
    """``mapInArrow`` whose state is built once per task by ``make``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield from step(batch)

    return df.mapInArrow(run, schema)


def per_text(
    docs: DataFrame, text_col: str, keep: list[str], added: str,
    make: Callable[[], Callable[[list[bytes]], list[pa.Array]]], limit: int = 4 << 20,
) -> DataFrame:
    """Columns ``keep`` of every row, then those of the DDL ``added``, which the function built by ``make`` computes from
    the texts of a slice of rows of about ``limit`` bytes. Kept columns may have any names and types."""
    kept = [f"_{i}" for i in range(len(keep))]
    names = [part.split()[0] for part in added.split(", ")]

    def build():
        compute = make()

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part in slices(batch, "text", limit):
                made = compute(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + made, names=kept + names)

        return step

    source = docs.select(*[docs[c].alias(k) for c, k in zip(keep, kept)], utf8(text_col).alias("text"))
    types = [f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(keep, kept)]
    out = per_row(source, ", ".join(types + [added]), build)
    return out.toDF(*keep, *names)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of ``batch`` whose ``column`` holds about ``limit`` bytes at most, one row at least."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)
