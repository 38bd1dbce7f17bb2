"""The projection index against the exact search: recall, work, odd vectors, crowded buckets."""

import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.operators import retrieval, vector_index

SCHEMA = "doc_id BIGINT, vector ARRAY<DOUBLE>"


def recall(spark, queries, docs, k, **how):
    pairs = lambda df: {(r["query_id"], r["doc_id"]) for r in df.collect()}
    exact, found = pairs(retrieval.cosine_topk(queries, docs, k)), pairs(vector_index.cosine_topk_index(queries, docs, k, **how))
    return len(exact & found) / len(exact), len(exact), len(found)


def scored(queries, docs, bits, probes):
    """Share of all pairs whose distance is computed."""
    index = vector_index.projection_codes(docs, "doc_id", bits=bits).select("slot", "code", "id")
    asked = vector_index.projection_codes(queries, "query_id", bits=bits, probes=probes).select("slot", "code", F.col("id").alias("q"))
    return asked.join(index, ["slot", "code"]).select("q", "id").distinct().count() / (docs.count() * queries.count())


def test_recall_on_given_vectors(spark):
    """Two thousand vectors without clusters: what is left out is little, and so is what it costs."""
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector")).cache()
    queries = docs.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    share, wanted, found = recall(spark, queries, docs, 3)
    assert share >= 0.9 and wanted == found
    assert vector_index.bits_for(docs.count()) == 6 and scored(queries, docs, 6, vector_index.PROBES) < 0.7


def test_recall_and_work_on_clusters(spark):
    """Forty clusters: at least 0.9 of the neighbours while a fifth of the pairs at most is scored."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(0, 40, 6000)] + 0.35 * rng.normal(size=(6000, 32))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).cache()
    queries = docs.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    share, wanted, found = recall(spark, queries, docs, 5, bits=9, probes=1)
    assert share >= 0.9 and wanted == found and scored(queries, docs, 9, 1) < 0.2


def test_odd_vectors_and_ties(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0, 0.0, 0.0]), (2, [2.0, 0.0])]
    docs = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame([(0, [3.0, 0.0]), (9, [0.0, 0.0])], "query_id BIGINT, vector ARRAY<DOUBLE>")
    got = vector_index.cosine_topk_index(queries, docs, 3, bits=2).orderBy("rank").collect()
    assert [(r["query_id"], r["doc_id"], r["distance"]) for r in got] == [(0, 1, 0.0), (0, 2, 0.0)]
    assert vector_index.cosine_topk_index(queries, docs.limit(0), 3).count() == 0


@pytest.mark.parametrize("block_rows", [7, 4000])
def test_one_crowded_bucket_is_searched_in_blocks(spark, block_rows):
    """A third of the documents are the same vector."""
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "query_id BIGINT, vector ARRAY<DOUBLE>")
    index = vector_index.projection_codes(docs, "doc_id", bits=3)
    got = vector_index.search_index(queries, index, 3, k=4, block_rows=block_rows).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [0, 3, 6, 9]


@pytest.mark.parametrize("probes", [0, 3])
def test_memory_of_coding_does_not_follow_batches_or_bits(probes):
    """Spark hands over ten thousand vectors at a time; a large index has long codes."""
    x = np.random.default_rng(2).normal(size=(10_000, 16))
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(10_001) * 16, pa.int32()), pa.array(x.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), vectors], names=["id", "vector"])
    peaks = {}
    for bits in (8, 20):
        tracemalloc.start()
        largest = max(b.nbytes for b in vector_index._coder(vector_index.TABLES, bits, probes, 1)(iter([batch])))
        peaks[bits] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert largest < 2**20
    assert peaks[20] < 2**25 and peaks[20] < 20 / 8 * 1.2 * peaks[8]


@pytest.mark.parametrize("bits, probes", [(1, 3), (2, 3), (9, 3), (9, 8), (9, 0)])
def test_probed_codes_are_the_cheapest_of_all_flips(spark, bits, probes):
    x = np.random.default_rng(3).normal(size=(1_200, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = {(r["id"], r["slot"], r["code"]) for r in vector_index.projection_codes(df, "doc_id", bits=bits, probes=probes, tables=2, seed=7).collect()}
    side = (x @ np.random.default_rng([7, 5]).standard_normal((5, 2 * bits))).reshape(-1, 2, bits)
    flips = [(), *combinations(range(bits), 1), *combinations(range(bits), 2)]
    wanted = set()
    for i, slot in np.ndindex(len(x), 2):
        code = sum(1 << b for b in range(bits) if side[i, slot, b] > 0)
        cheap = sorted(flips, key=lambda f: sum(side[i, slot, b] ** 2 for b in f))[: probes + 1]  # noqa: B023
        wanted |= {(i, slot, code ^ sum(1 << b for b in f)) for f in cheap}
    assert got == wanted


def test_crowded_buckets_are_cut_by_queries_too(spark):
    """Six hundred equal queries and five hundred equal documents, among others, in blocks of any size."""
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0] if i < 600 else rng.normal(size=3).tolist()) for i in range(900)]
    queries = spark.createDataFrame(rows, "query_id BIGINT, vector ARRAY<DOUBLE>").cache()
    index = vector_index.projection_codes(spark.createDataFrame(rows[100:], SCHEMA), "doc_id", bits=3)
    got = [
        {tuple(r) for r in vector_index.search_index(queries, index, 3, k=2, block_rows=rows_, block_queries=asked).select("query_id", "rank", "doc_id", "distance").collect()}
        for rows_, asked in ((4_000, 1_000), (4_000, 90), (70, 1_000), (70, 90))
    ]
    assert all(g == got[0] for g in got) and {r[1:3] for r in got[0] if r[0] < 600} == {(1, 100), (2, 101)}
    assert {r[0] for r in got[0]} == set(range(900))


def test_recall_holds_as_the_table_grows(spark):
    """Codes of nine bits for vectors without clusters, each query itself left out."""
    x = np.random.default_rng(6).normal(size=(12_000, 64))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).cache()
    queries = docs.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    share, wanted, found = recall(spark, queries, docs, 4)
    assert vector_index.bits_for(docs.count()) == 9 and wanted == found and (4 * share - 1) / 3 >= 0.9
