"""Random projection index for cosine search (R5, O4): candidates by hash code, scores by the vectors themselves.

A table has ``bits`` random directions, and a vector's code holds the sides of them on which it lies. Close vectors share codes in some of
the tables. A query also probes the codes that differ in the bits it is least sure of. Neighbouring buckets are searched together, a crowded one by itself in blocks
of documents and of queries, and every block returns just its own best.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import nearest

TABLES, PROBES, SEED = 16, 3, 20240
#: Documents and queries of a block, and about as many documents in a bucket of evenly spread vectors
BLOCK, BLOCK_QUERIES, BUCKET = 4_000, 1_000, 32
#: Codes that differ in so many low bits are searched together; a bucket of more rows than CROWDED stands by itself
SHARED_BITS, CROWDED = 5, 256
#: Vectors whose sides a task holds at a time
SLICE = 512


def bits_for(n: int) -> int:
    """Bits per code for about BUCKET documents in a bucket."""
    return max(1, min(24, round(math.log2(max(2, n) / BUCKET))))


def probes_for(bits: int) -> int:
    """Probes per table: PROBES for short codes; long ones split close vectors more often and need all sets of one or two bits."""
    return PROBES if bits <= 6 else bits * (bits + 1) // 2


def _flips(bits: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of at most two among a code's least sure bits: the cheapest ``probes`` sets hold no bit beyond as many."""
    sure = range(min(bits, probes))
    return [(), *[(i,) for i in sure], *combinations(sure, 2)]


def _coder(tables: int, bits: int, probes: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, vector, codes): every table's probed codes, one table after the other; vectors without a direction have no row."""
    flips = _flips(bits, probes)

    def coded(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
        side = (x @ planes).reshape(-1, tables, bits)
        code = ((side > 0) << np.arange(bits)).sum(axis=2)
        if not probes:
            return code
        # What a set of flips costs: how far the vector lies from the planes that it crosses
        unsure = np.argsort(side**2, axis=2, kind="stable")[:, :, :probes]
        far, change = np.take_along_axis(side, unsure, axis=2) ** 2, 1 << unsure
        cost = np.stack([far[:, :, list(f)].sum(axis=2) for f in flips], axis=2)
        changes = np.stack([change[:, :, list(f)].sum(axis=2) for f in flips], axis=2)
        best = np.argsort(cost, axis=2, kind="stable")[:, :, : probes + 1]
        return (code[:, :, None] ^ np.take_along_axis(changes, best, axis=2)).reshape(len(x), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                vectors = batch.column("vector")
                sizes = np.diff(vectors.offsets.to_numpy())
                for dims in np.unique(sizes[sizes > 0]):
                    rows = np.flatnonzero((sizes == dims) & vectors.is_valid().to_numpy(zero_copy_only=False))
                    x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                    sound = np.isfinite(x).all(axis=1) & x.any(axis=1)
                    rows, x = rows[sound], x[sound]
                    if not len(rows):
                        continue
                    planes = np.random.default_rng([seed, int(dims)]).standard_normal((int(dims), tables * bits))
                    codes = coded(x, planes)
                    at, ends = pa.array(rows), np.arange(len(rows) + 1, dtype="int32") * codes.shape[1]
                    listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.ravel(), pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(at), vectors.take(at), listed], names=["id", "vector", "codes"])

    return run


def projection_codes(
    vectors: DataFrame, id_col: str, vector_col: str = "vector", bits: int = 8, probes: int = 0, tables: int = TABLES, seed: int = SEED
) -> DataFrame:
    """(id, vector, slot, code): one row per table and probed code. Null, empty, zero and non-finite vectors have no rows.

    Without ``probes`` this is the index; write it, and search it as often as wanted with the same bits, tables and seed.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    coded = rows.mapInArrow(_coder(tables, bits, probes, seed), "id bigint, vector array<double>, codes array<int>")
    each = min(probes + 1, len(_flips(bits, probes)))
    codes = coded.select("id", "vector", F.posexplode("codes").alias("_at", "code"))
    return codes.select("id", "vector", F.floor(F.col("_at") / each).cast("int").alias("slot"), "code")


def _bucket_scores(k: int, digits: int) -> Callable:
    """The best k of every query in each bucket that the documents and queries of a group share."""

    def score(key, docs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = [(np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))]
        if not docs.empty and not queries.empty:
            d, q = np.vstack(docs["vector"].to_numpy()), np.vstack(queries["vector"].to_numpy())
            ids, asked, own = docs["doc_id"].to_numpy(), queries["query_id"].to_numpy(), docs.groupby("code").indices
            for code, at in queries.groupby("code").indices.items():
                if code in own:
                    found.append(nearest(d[own[code]], ids[own[code]], q[at], asked[at], k, digits))
        return pd.DataFrame({name: np.concatenate(x) for name, x in zip(("query_id", "doc_id", "distance"), zip(*found))})

    return score


def search_index(
    queries: DataFrame, index: DataFrame, bits: int, k: int = 3, probes: int = PROBES, digits: int = 9, block_rows: int = BLOCK,
    tables: int = TABLES, seed: int = SEED, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, doc_id, distance, rank): the nearest among the documents that share a code with the query, by exact cosine distance.

    ``queries(query_id, vector)``; ties by document id. Documents that no table brings together with a query are missed;
    ``retrieval.cosine_topk`` misses none.
    """
    bucket = ["slot", "code", "dims"]  # vectors of another length take no part
    index = index.withColumn("dims", F.size("vector"))
    asked = projection_codes(queries, "query_id", bits=bits, probes=probes, tables=tables, seed=seed).withColumn("dims", F.size("vector"))
    counts = index.groupBy(*bucket).agg(F.count("*").alias("n")).join(asked.groupBy(*bucket).agg(F.count("*").alias("m")), bucket)
    crowded = (F.col("n") > min(CROWDED, block_rows)) | (F.col("m") > min(CROWDED, block_queries))
    pieces = [F.when(crowded, F.ceil(F.col(rows) / most)).otherwise(1).cast("int").alias(rows) for rows, most in (("n", block_rows), ("m", block_queries))]
    blocks = counts.select(
        *bucket, F.when(crowded, -1 - F.col("code")).otherwise(F.shiftright("code", SHARED_BITS)).alias("home"), *pieces)
    place = ["slot", "dims", "share", "block", "part"]
    docs = index.join(blocks, bucket).withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("share", F.col("home")).select(*place, "code", F.col("id").alias("doc_id"), "vector")
    asked = asked.join(blocks, bucket).withColumn("part", F.pmod(F.xxhash64("id"), F.col("m")).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("share", F.col("home")).select(*place, "code", F.col("id").alias("query_id"), "vector")
    found = docs.groupBy(*place).cogroup(asked.groupBy(*place)).applyInPandas(_bucket_scores(k, digits), "query_id BIGINT, doc_id BIGINT, distance DOUBLE")
    best = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    once = found.groupBy("query_id", "doc_id").agg(F.min("distance").alias("distance"))
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def cosine_topk_index(queries: DataFrame, docs: DataFrame, k: int = 3, probes: int | None = None, bits: int | None = None) -> DataFrame:
    """``search_index`` over an index of all of ``docs(doc_id, vector)``, made for this search."""
    bits = bits or bits_for(docs.count())
    return search_index(queries, projection_codes(docs, "doc_id", bits=bits), bits, k, probes_for(bits) if probes is None else probes)


# Functions for Python workers travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
