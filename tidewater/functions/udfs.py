"""Where Python code may plug in: a vectorised scoring slot and table functions for SQL."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import fixed_values as fx

ITEM_PATHS = fx.ITEM_PATHS


def score_rows(df: DataFrame, inputs: list[str], scorer: Callable[[np.ndarray], np.ndarray], name: str = "score") -> DataFrame:
    """Add ``scorer(matrix)`` evaluated once per Arrow batch; one row per score, missing inputs arrive as NaN."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.asarray(scorer(batch.to_numpy(dtype="float64")), dtype="float64"))

    return df.withColumn(name, run(F.struct(*[F.col(c).cast("double").alias(c) for c in inputs])))


def _kept(rows: AnalyzeArgument, column: AnalyzeArgument) -> T.StructType:
    """The columns of the table argument without the one that the function takes apart."""
    if not rows.isTable or column.value not in rows.dataType.names:
        raise ValueError("call it as f(TABLE(t) PARTITION BY (...), 'column'), with a column of t")
    return T.StructType([f for f in rows.dataType.fields if f.name != column.value])


class EnvelopeItems:
    """SQL table function ``f(TABLE(t) ..., 'payload')``: the other columns of t, item_no and item of every item of a landed JSON payload."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, payload: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(_kept(rows, payload).add("item_no", T.IntegerType()).add("item", T.StringType()))

    def eval(self, rows, payload):
        try:
            document = json.loads(rows[payload])
        except (ValueError, TypeError):
            return
        for path in ITEM_PATHS:
            node = document
            for name in path.split(".")[1:]:
                node = node.get(name) if isinstance(node, dict) else None
            if node is not None:
                rest = [v for n, v in rows.asDict().items() if n != payload]
                for i, item in enumerate(node if isinstance(node, list) else [node]):
                    yield (*rest, i, json.dumps(item, ensure_ascii=False, separators=(",", ":")))
                return


class Paragraphs:
    """SQL table function ``f(TABLE(t) ..., 'text')``: the other columns of t, paragraph_no and paragraph of every text that isn't blank."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(_kept(rows, text).add("paragraph_no", T.IntegerType()).add("paragraph", T.StringType()))

    def eval(self, rows, text):
        rest = [v for n, v in rows.asDict().items() if n != text]
        kept = [p for p in ((x.strip(" \n\t\r")) for x in (rows[text] or "").split("\n\n")) if p]
        for i, paragraph in enumerate(kept):
            yield (*rest, i, paragraph)


def register_table_functions(spark: SparkSession) -> list[str]:
    """Rows travel in Arrow batches; PARTITION BY spreads a table over tasks."""
    spark.udtf.register("tw_envelope_items", F.udtf(EnvelopeItems, useArrow=True))
    spark.udtf.register("tw_paragraphs", F.udtf(Paragraphs, useArrow=True))
    return ["tw_envelope_items", "tw_paragraphs"]


# Functions for Python workers travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
