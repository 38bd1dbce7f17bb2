"""Document sections, chunks, vector search and prompt assembly."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions import text as tx
from ..plans.ordering import row_index


def split_sections(docs: DataFrame, doc: list[str], title: str, body: str) -> DataFrame:
    """Heading levels 1-3 start a section; text before the first heading keeps the document title.

    Sections are found inside the row by splitting in front of heading lines, so a document never leaves its row.
    """
    marked = F.regexp_replace(tx.strip_controls(F.col(body)), r"(?m)^(#{1,3}[ \t]+[^\n]+)$", "\x1e$1")
    pieces = F.split(marked, "\x1e")
    sections = docs.select(*doc, title, F.posexplode(pieces).alias("section_no", "_s"))
    heading = F.regexp_extract("_s", r"^#{1,3}[ \t]+([^\n]+)", 1)
    has_heading = F.col("_s").rlike(r"^#{1,3}[ \t]+[^\n]+(\n|$)") & (F.col("section_no") > 0)
    content = F.when(has_heading, F.regexp_replace("_s", r"^#{1,3}[ \t]+[^\n]+\n?", "")).otherwise(F.col("_s"))
    return (
        sections.withColumn("section_title", F.when(has_heading, F.ltrim(F.trim(heading), F.lit("#"))).otherwise(F.col(title)))
        .withColumn("section_title", F.trim("section_title"))
        .withColumn("content", tx.sanitize_markdown(content))
        .filter(F.length("content") >= fx.MIN_CHUNK_CHARS)
        .drop("_s")
    )


def chunk_documents(docs: DataFrame, keys: list[str], text: str, limit: int = fx.MAX_CHUNK_CHARS) -> DataFrame:
    """One row per chunk, short chunks dropped; ``chunk_no`` is the position before dropping."""
    exploded = docs.select(*keys, F.posexplode(tx.chunk_text(F.col(text), limit)).alias("chunk_no", "content"))
    return exploded.filter(F.length("content") >= fx.MIN_CHUNK_CHARS)


def section_chunks(docs: DataFrame, doc: list[str], title: str, body: str, limit: int = fx.MAX_CHUNK_CHARS) -> DataFrame:
    """Chunks inside the sections of every document, titled 'document — section' (the document's title before a heading)."""
    sections = split_sections(docs, doc, title, body)
    named = F.when(F.col("section_title") == F.col(title), F.col(title)).otherwise(F.concat_ws(" — ", title, "section_title"))
    titled = sections.withColumn("_title", named)
    chunks = chunk_documents(titled, [*doc, "section_no", "_title"], "content", limit)
    return chunks.select(*doc, "section_no", "chunk_no", F.col("_title").alias("title"), "content")


def assign_chunk_ids(chunks: DataFrame, order: list[tuple[str, bool]], title: str = "title") -> DataFrame:
    """Zero-padded running ids in document order and the text that gets indexed."""
    placed = row_index(chunks, [], order, "_pos")
    return placed.withColumn("chunk_id", tx.running_doc_id(F.col("_pos") - 1)).withColumn(
        "index_text", F.concat_ws("\n", title, "content")
    ).drop("_pos")


def nearest(
    docs: np.ndarray, ids: np.ndarray, queries: np.ndarray, asked: np.ndarray, k: int, digits: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, doc_id, distance) of the best k documents of every query, by one matrix product."""
    d_norm, q_norm = np.sqrt((docs * docs).sum(1)), np.sqrt((queries * queries).sum(1))
    d, ids, q, asked = docs[d_norm > 0], ids[d_norm > 0], queries[q_norm > 0], asked[q_norm > 0]
    if not len(d) or not len(q):
        return np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)
    distance = np.round(1.0 - (q @ d.T) / (q_norm[q_norm > 0][:, None] * d_norm[d_norm > 0][None, :]), digits)
    last = min(k, len(ids)) - 1
    cut = np.partition(distance, last, axis=1)[:, last]
    best = []
    for i in range(len(asked)):
        near = np.flatnonzero(distance[i] <= cut[i])
        best.append(near[np.lexsort((ids[near], distance[i][near]))[:k]])
    rows, places = np.repeat(np.arange(len(asked)), [len(b) for b in best]), np.concatenate(best)
    return asked[rows], ids[places], distance[rows, places]


def block_scores(k: int, digits: int):
    def score(key, docs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)
        if not docs.empty and not queries.empty:
            d = np.vstack(docs["vector"].to_numpy()).astype(np.float64)
            q = np.vstack(queries["vector"].to_numpy()).astype(np.float64)
            found = nearest(d, docs["doc_id"].to_numpy(), q, queries["query_id"].to_numpy(), k, digits)
        return pd.DataFrame(dict(zip(("query_id", "doc_id", "distance"), found)))

    return score


def cosine_topk(
    queries: DataFrame, docs: DataFrame, k: int = 3, digits: int = 9, block_rows: int = 4_000, block_queries: int = 1_000
) -> DataFrame:
    """Exact k nearest documents per query by cosine distance, ties by document id.

    Documents and queries are cut into blocks of about ``block_rows`` and ``block_queries``; each pair of blocks is one
    matrix product (32 MB at the default sizes) that returns only its own best k per query, and the block winners are
    merged. ``queries(query_id, vector)``, ``docs(doc_id, vector)`` with BIGINT ids. A zero vector has no direction: such
    documents and queries give no rows.
    """
    n_docs = max(1, -(-docs.count() // block_rows))
    n_queries = max(1, -(-queries.count() // block_queries))
    left = docs.withColumn("_d", F.pmod(F.xxhash64("doc_id"), F.lit(n_docs)).cast("int")).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))
    )
    right = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(n_queries)).cast("int")).withColumn(
        "_d", F.explode(F.sequence(F.lit(0), F.lit(n_docs - 1)))
    )
    best = (
        left.groupBy("_d", "_q")
        .cogroup(right.groupBy("_d", "_q"))
        .applyInPandas(block_scores(k, digits), "query_id BIGINT, doc_id BIGINT, distance DOUBLE")
    )
    w = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def build_prompt(question: Column, docs: Column, context: Column | None = None) -> Column:
    """Prompt text from a ranked array of struct(title, source, content) and optional sensor lines."""
    lines = F.transform(
        docs,
        lambda d, i: F.concat(
            F.lit(fx.DOCUMENT_LEAD), (i + 1).cast("string"), F.lit("] "), F.coalesce(d.title, F.lit("")),
            F.lit(fx.SOURCE_LEAD), F.coalesce(d.source, F.lit("?")), F.lit(")\n"), d.content,
        ),
    )
    listed = F.when(F.size(docs) > 0, F.array_join(lines, "\n\n")).otherwise(fx.NO_DOCUMENTS_PROMPT)
    sensors = F.lit("")
    if context is not None:
        sensors = F.when(context != "", F.concat(F.lit(fx.SENSORS_HEAD), context)).otherwise("")
    return F.concat(
        sensors, F.lit(fx.DOCUMENTS_HEAD), listed, F.lit(fx.QUESTION_HEAD), question, F.lit("\n\n" + fx.PROMPT_CLOSING)
    )


def template_answer(docs: Column) -> Column:
    """First three sentences of the best document and the list of sources."""
    sentences = F.split(docs[0]["content"], r"\. ")
    summary = F.array_join(F.slice(sentences, 1, 3), ". ")
    refs = F.array_join(
        F.transform(
            docs,
            lambda d: F.concat(
                F.lit("  - "), F.coalesce(d.title, F.lit("")), F.lit(fx.SOURCE_LEAD), F.coalesce(d.source, F.lit("?")), F.lit(")")
            ),
        ),
        "\n",
    )
    full = F.concat(summary, F.lit(fx.DOCUMENTS_HEAD), refs, F.lit("\n\n" + fx.ANSWER_CLOSING))
    return F.when(F.size(docs) > 0, full).otherwise(fx.NO_DOCUMENTS_ANSWER)


# Functions for Python workers travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
