"""Corpus pipeline: language, near-duplicates, benchmark leaks, personal data, tokens; each stage over what the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe, decontaminate, langid, minhash, pii
from tidewater.llm.shared import staged, table

#: A document is rejected if no learned language explains this share of its letters
LEAST_SHARE = 0.3
#: A document is rejected if all learned languages together, beside the background, explain less. In sf0.01, held-out texts have
#: 0.99 or more, Finnish 0.49, letters at random and other scripts below 0.1
LEAST_EXPLAINED = 0.6
#: Id lists up to this number (8 MB) are broadcast, else joined by a shuffle
BROADCAST_IDS = 1 << 20
RANKS = "byte_bpe_50k.tiktoken"


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key ``_row`` of their own, in the order of their ids, nulls last: the id where no id is null or repeated."""
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn("_row", F.col("doc_id"))
    # The second key lets the sort split rows of one id
    ordered = docs.withColumn("_at", F.monotonically_increasing_id()).orderBy(F.col("doc_id").asc_nulls_last(), "_at").drop("_at")
    return staged(ordered.withColumn("_row", F.monotonically_increasing_id()), "keyed")


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    rows = staged(rows.distinct(), "dropped")
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows, "_row", "left_anti").drop("_row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which the learned languages explain LEAST_EXPLAINED and one of them LEAST_SHARE; texts in languages or scripts
    that were not learned, gibberish, null texts and texts without a letter go.

    The languages are learned from the documents' own labels. Where no document has a label, nothing is rejected but
    texts without letters.
    """
    model = langid.train(docs)
    if not model["languages"]:
        return docs.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    found = langid.identify(docs, model, keep=docs.columns, with_explained=True)
    sound = (F.col("explained") >= LEAST_EXPLAINED) & (F.col("score") >= LEAST_SHARE)
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & sound).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of every group of near-duplicates (five words, similarity 0.8).

    Rows are judged one by one, also those that share an id or have none. Texts without words stay.
    """
    keyed = _keyed(docs)
    judged = minhash.near_duplicates(keyed, "_row", width=5, percent=80)
    return _without(keyed, judged.filter("not kept").select("_row")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a benchmark item, also a re-parameterised one."""
    keyed = _keyed(docs)
    found = decontaminate.find_leaks(keyed, table(spark, sf_dir, "benchmark"), "_row")
    return _without(keyed, found.select("_row")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind in brackets and counts the characters anew; keeps every row."""
    found = pii.find_spans(docs, "text", "_spans")
    text = F.when(F.size("_spans") > 0, pii.redact(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))
    clean = found.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))
    return clean.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every document; ``round_trip`` says that the decoded ids are the text."""
    path = public_tokenizers.path(RANKS)
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN, verify=True)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("personal_data", personal_data), ("tokens", tokens),
]

#: Mixture inference, MinHash components and byte merges have no SQL; tests/llm holds a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
