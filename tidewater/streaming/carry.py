"""Micro-batch execution with a small state table carried from batch to batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

Carry = DataFrame | Callable[[DataFrame], DataFrame]
Step = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, Carry]]


def start_with_carry(stream: DataFrame, step: Step, path: str, trigger: dict | None = None) -> StreamingQuery:
    """Run ``step(batch, carry) -> (output, new_carry)`` per micro-batch.

    The new carry is a DataFrame, or a function of the output as written, so that the output is computed once.

    Output and carry are written under the batch number, and a batch reads the carry of its predecessor. A batch that
    is repeated after a failure therefore replaces its own files and nothing is counted twice.
    """
    spark = stream.sparkSession

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.parquet(f"{path}/carry/batch={batch_id - 1}") if batch_id > 0 else None
        batch = batch.persist()
        try:
            out, carry = step(batch, before)
            out.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")
            if callable(carry):
                carry = carry(spark.read.parquet(f"{path}/out/batch={batch_id}"))
            carry.write.mode("overwrite").parquet(f"{path}/carry/batch={batch_id}")
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_updates(
    aggregate: DataFrame, path: str, mode: str = "update", trigger: dict | None = None, finish: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Write every micro-batch's new or changed rows, or what ``finish`` makes of them, under its batch number."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        (finish(batch) if finish else batch).write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    return (
        aggregate.writeStream.outputMode(mode).foreachBatch(on_batch)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def output_of(spark: SparkSession, path: str) -> DataFrame:
    """All output rows with the batch that wrote them."""
    return spark.read.parquet(f"{path}/out")
