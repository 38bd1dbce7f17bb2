"""Exact top-k by inner product: Fagin's threshold algorithm, block by block.

Candidates and queries are dealt into blocks; every pair of blocks is one group. Within it each dimension has one list of
the block's candidates sorted by that component. A query walks all lists from their better end in step; a row met for the
first time is scored in full. The bound is the score of an imaginary row made of the components at the current depth: once
it is below the k-th best score, no unmet row can enter or tie, and the walk stops.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

#: Rows of a block pair: at most about this many candidates (x queries) are held by one task at a time
CANDIDATES, QUERIES = 1024, 2048
_LONG = (1 << 63) - 1


def quantized(vectors: DataFrame, id_col: str, vector_col: str, factor: int) -> DataFrame:
    """(id, v array<bigint>): floor(factor * x) with x as double. Vectors that are null, empty, or hold a null or non-finite
    component are left out, and so are null ids; rows that share an id all stay."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.size(v).__gt__(0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.filter(F.col(id_col).isNotNull() & F.coalesce(sound, F.lit(False)))
        .select(F.col(id_col).cast("bigint").alias("id"), F.transform(v, lambda x: F.floor(x * factor)).alias("v"))
    )


def threshold_search(
    rows: np.ndarray, ids: np.ndarray, order: np.ndarray, query: np.ndarray, own: int, k: int, keys: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """The k best (score, id) of the rows, without those whose key is ``own``; ties to smaller ids. Without ``keys`` the ids are the keys.

    ``order[d]`` sorts the rows by component d, ascending. Scores are exact: sums in float64 when they fit, else integers.
    """
    n, dims = rows.shape
    others = (ids if keys is None else keys) != own
    best: list[tuple[int, int]] = []
    met = np.zeros(n, bool)
    up = query > 0
    used = np.flatnonzero(query != 0)
    depth, step = 0, max(8, n // 16)
    if not len(used):
        used, up = np.arange(min(1, dims)), np.ones(dims, bool)
    while depth < n:
        stop = min(n, depth + step)
        heads = np.concatenate([order[d, n - stop : n - depth] if up[d] else order[d, depth:stop] for d in used])
        fresh = np.zeros(n, bool)
        fresh[heads] = True
        fresh &= ~met
        met |= fresh
        at = np.flatnonzero(fresh & others)
        if len(at):
            scores = rows[at] @ query
            if len(at) > k:
                cut = np.partition(scores, len(at) - k)[len(at) - k]
                keep = scores >= cut
                at, scores = at[keep], scores[keep]
            best = sorted(best + [(int(s), int(i)) for s, i in zip(scores, ids[at])], key=lambda x: (-x[0], x[1]))[:k]
        depth = stop
        edge = [rows[order[d, n - depth] if up[d] else order[d, depth - 1], d] for d in used]
        if len(best) == k and best[-1][0] > int(np.dot(edge, query[used])):
            break
        step *= 2
    return best


def _matrix(table: pa.Table) -> np.ndarray:
    v = table.column("v").combine_chunks()
    return v.flatten().to_numpy().reshape(len(table), -1) if len(table) else np.zeros((0, 1), np.int64)


def _search(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if len(queries) and len(candidates):
            q, x, ids, keys = _matrix(queries), _matrix(candidates), candidates.column("id").to_numpy(), candidates.column("key").to_numpy()
            # Every partial sum stays below 2^53, so float64 products are exact; larger components use Python integers
            exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2.0**53
            q, x = (m.astype(np.float64 if exact else object) for m in (q, x))
            order = np.argsort(x, axis=0, kind="stable").T.copy()
            for own, query_id, query in zip(queries.column("key").to_pylist(), queries.column("id").to_pylist(), q):
                for score, i in threshold_search(x, ids, order, query, own, k, keys):
                    for column, value in zip(out, (own, query_id, i, max(-_LONG - 1, min(_LONG, score)))):
                        column.append(value)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["key", "query_id", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame, is_query: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of every query row with every other row.

    Rows that share an id are rows of their own: each is a candidate, also for the others, and each query row has its own ranks.
    Queries are the rows for which the SQL condition ``is_query`` (over the column ``id``) holds. Ties go to the smaller id;
    fewer than k rows give all of them. Vectors of another length than the query's take no part in its search. A score
    beyond the range of a long is clamped to it. Other columns are ignored; an empty table gives no rows.
    """
    data = quantized(vectors, id_col, vector_col, factor).withColumns({"dims": F.size("v"), "key": F.monotonically_increasing_id()})
    data = staged(data, "vectors")  # written, so that a row keeps its key
    queries = data.filter(is_query)
    total, asked = data.count(), queries.count()
    parts, groups = max(1, -(-total // CANDIDATES)), max(1, -(-asked // QUERIES))
    cell = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("g", cell(groups)).withColumn("c", every(parts)).select("dims", "g", "c", "key", "id", "v")
    right = data.withColumn("c", cell(parts)).withColumn("g", every(groups)).select("dims", "g", "c", "key", "id", "v")
    found = left.groupBy("dims", "g", "c").cogroup(right.groupBy("dims", "g", "c")).applyInArrow(
        _search(k), "key bigint, query_id bigint, vec_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
