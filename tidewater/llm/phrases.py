"""Phrase collocations from a weighted de Bruijn graph of the words of each language.

Edges are grams of LONGEST words between the two nodes of one word less that overlap in them. One record is counted per word of
the corpus: the longest gram that begins there, which is shorter only where a piece ends. Unary paths, on which every node
has all its flow from one edge and to one edge, are compacted to long phrases. Counts of shorter phrases follow from node flow:
what flows out of a node, and the corrections for pieces that end in it.

Before, a sketch of fixed size takes the occurrences of all grams of two and three words. It never counts too little, so a gram that
stays below the least count there is in no candidate, and records are cut in front of it. That saves volume and changes no count.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, staged

LONGEST = 5
#: Counters of the sketch, of one byte each in a task and one bit each in the broadcast (8 MB). It prunes well up to about
#: ten times as many words as it has counters, and less and less beyond
SLOTS = 1 << 26
#: Counters that travel together
BLOCK = 1 << 16
#: Words that one step of numpy handles, and phrases that a task holds before it hands them on
STEP_WORDS, HELD = 1 << 16, 400_000

# A-Z in lower case, tabs as spaces, what ends a piece as a line end
_PLAIN = bytes(b | 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if chr(b) in ".,;:!?\n\v\f\r" else b for b in range(256))
_SPACES = re.compile(rb" {2,}")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts of one language, step by step.

    A step has the bytes, the words' bounds in them, the number of words that begin in the step, up to LONGEST - 1 words that follow
    them, and for every word whether the next one stands in the same piece.
    """

    def __init__(self, texts: list[bytes]):
        self.text = _SPACES.sub(b" ", b"\n".join(texts).translate(_PLAIN))
        raw = np.frombuffer(self.text, np.uint8)
        inside = np.concatenate([[False], (raw != 32) & (raw != 10), [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.stop = turns[::2], turns[1::2]
        gaps = raw[self.stop[:-1]] if len(self.stop) else raw[:0]
        # A gap of one space is the only one without a line end, or a line end follows the space
        self.joined = np.append((gaps == 32) & (self.start[1:] - self.stop[:-1] == 1), False) if len(self.start) else np.zeros(0, bool)

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
        for i in range(0, len(self.start), STEP_WORDS):
            j = min(i + STEP_WORDS + LONGEST - 1, len(self.start))
            yield self.start[i:j], self.stop[i:j], min(STEP_WORDS, len(self.start) - i), self.joined[i:j]

    def grams(self, start: np.ndarray, stop: np.ndarray, joined: np.ndarray, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(hash, whether all its words are in one piece) of the grams of two and of three words that begin at each word."""
        first = int(start[0])
        raw = np.frombuffer(self.text, np.uint8)[first : int(stop[-1])].astype(np.uint64)
        power = np.cumprod(np.full(len(raw), _BASE, np.uint64))
        back = np.cumprod(np.full(len(raw), _INVERSE, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * power)])
        word = _mixed((sums[stop - first] - sums[start - first]) * back[start - first] + np.uint64(seed))
        out, gram, whole = [], word, np.ones(len(word), bool)
        for k in (1, 2):
            after = np.zeros(len(word), np.uint64)
            after[:-k] = word[k:]
            linked = np.zeros(len(word), bool)
            linked[: len(word) - k + 1] = joined[k - 1 :]
            gram, whole = _mixed(gram * np.uint64(_BASE) + after), whole & linked
            out.append((gram, whole))
        return out


def _by_lang(part: pa.RecordBatch) -> Iterator[tuple[str, int, Words]]:
    groups: dict[str, list[bytes]] = {}
    for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
        groups.setdefault(lang, []).append(text)
    for lang, texts in groups.items():
        yield lang, xxhash.xxh3_64_intdigest(lang.encode()), Words(texts)


def _sketch(least: int, slots: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, data): counters of grams, none above ``least``, which sums keep on the right side of it."""
    kind = np.uint8 if least < 256 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(slots, kind)
        for batch in batches:
            for part in slices(batch, "text"):
                for _, seed, words in _by_lang(part):
                    for start, stop, own, joined in words.steps():
                        for gram, whole in words.grams(start, stop, joined, seed):
                            at, n = np.unique((gram[:own][whole[:own]] & np.uint64(slots - 1)).astype(np.int64), return_counts=True)
                            table[at] = np.minimum(table[at] + n, least)
        for block in range(0, slots, BLOCK):
            part = table[block : block + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block // BLOCK], pa.int32()), "data": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    return run


def _summed(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, bits) from rows in the order of blocks: one bit per counter that reaches ``least``."""
    kind = np.uint8 if least < 256 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "bits": pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())})

        for batch in batches:
            for at, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                part = np.frombuffer(zlib.decompress(data), kind).astype(np.int64)
                if at == block:
                    total += part
                else:
                    if block is not None:
                        yield done()
                    block, total = at, part
        if block is not None:
            yield done()

    return run


def _records(frequent, slots: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, words, phrase, n): occurrences of each longest gram; a gram may be handed on several times. words = 0 counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(frequent.value, np.uint8)
        counts: dict[str, list[Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, by_length in counts.items():
                for k, found in enumerate(by_length):
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([lang] * len(found), pa.string()), pa.array([k] * len(found), pa.int32()),
                                pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64()),
                            ],
                            names=["lang", "words", "phrase", "n"],
                        )
            counts.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                for lang, seed, words in _by_lang(part):
                    by_length = counts.setdefault(lang, [Counter() for _ in range(LONGEST + 1)])
                    text = words.text
                    for start, stop, own, joined in words.steps():
                        by_length[0][b""] += own
                        known = []
                        for gram, whole in words.grams(start, stop, joined, seed):
                            at = (gram & np.uint64(slots - 1)).astype(np.int64)
                            known.append(whole & ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool))
                        length, runs = np.ones(len(start), np.int64), np.ones(len(start), bool)
                        for k in range(1, LONGEST):
                            # The next word continues the gram if the two or three words that it ends may be frequent
                            last = known[min(k, 2) - 1][max(0, k - 2) :]
                            runs = runs & np.append(last, np.zeros(len(runs) - len(last), bool))
                            length += runs
                        length = length[:own]
                        for k in range(1, LONGEST + 1):
                            at = np.flatnonzero(length == k)
                            by_length[k].update([text[a:b] for a, b in zip(start[at].tolist(), stop[at + k - 1].tolist())])
                if sum(len(c) for x in counts.values() for c in x) > HELD:
                    yield from flush()
        yield from flush()

    return run


def gram_records(docs: DataFrame, least: int = 100, lang_col: str = "lang", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(lang, words, phrase, n): how often each longest gram is the longest one that begins at a word.

    A gram of fewer than LONGEST words stands for places where its piece ends or no phrase of ``least`` occurrences goes on.
    The row with words = 0 has the number of words of the language.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    counted = rows.mapInArrow(_sketch(least, slots), "block int, data binary")
    merged = counted.repartition("block").sortWithinPartitions("block").mapInArrow(_summed(least), "block int, bits binary")
    bits = bytearray(max(slots, BLOCK) // 8)
    for row in merged.collect():  # slots / 8 bytes at most
        at = row["block"] * BLOCK // 8
        bits[at : at + len(row["bits"])] = row["bits"]
    found = rows.mapInArrow(_records(spark.sparkContext.broadcast(bytes(bits)), slots), "lang string, words int, phrase binary, n bigint")
    return found.groupBy("lang", "words", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("n"))


def _head(phrase: str, words: int):
    return F.substring_index(phrase, " ", words)


def _tail(phrase: str, words: int):
    return F.substring_index(phrase, " ", -words)


def node_flow(records: DataFrame) -> dict[int, DataFrame]:
    """By number of words from LONGEST to 1: (lang, phrase, n). What flows out of a node, and the pieces that end in it.

    ``n`` is the number of occurrences of every phrase that occurs ``least`` times, and at most that of others.
    """
    flow: dict[int, DataFrame] = {}
    for k in range(LONGEST, 0, -1):
        here = records.filter(F.col("words") == k).select("lang", "phrase", "n")
        if k < LONGEST:
            here = here.unionByName(flow[k + 1].select("lang", _head("phrase", k).alias("phrase"), "n"))
        flow[k] = staged(here.groupBy("lang", "phrase").agg(F.sum("n").alias("n")), f"flow{k}")
    return flow


def compact_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lang, phrase, n, words): maximal unary paths, as the phrase that their edges spell; every edge lies on one path.

    Two edges of equal count are joined where they meet in a node that has this count too: all its flow comes from the one and goes
    on to the other. ``edges`` have LONGEST words, ``nodes`` one less. Pieces end, so no path is a circle. Each round doubles
    the stretch that an edge looks back, and only edges that have not found the beginning of their path take part.
    """
    k = LONGEST - 1
    node = nodes.select("lang", F.col("phrase").alias("node"), F.col("n").alias("flow"))
    into = edges.select("lang", F.col("phrase").alias("before"), _tail("phrase", k).alias("node"), "n").join(node, ["lang", "node"]).filter("n = flow")
    out = edges.select("lang", "phrase", _head("phrase", k).alias("node"), F.col("n").alias("n_out"))
    linked = out.join(into, ["lang", "node"]).filter("n_out = n").select("lang", "phrase", "before", F.lit(1).alias("steps"))
    open_ = staged(linked, "links")
    begins = edges.join(open_.select("lang", "phrase"), ["lang", "phrase"], "left_anti").select("lang", "phrase")
    done = staged(begins.select("lang", "phrase", F.col("phrase").alias("first"), F.lit(0).alias("steps")), "begins")
    while not open_.isEmpty():
        # Edges whose predecessor has found the beginning are done; the others look back twice as far
        reached = done.select("lang", F.col("phrase").alias("before"), "first", F.col("steps").alias("more"))
        found = open_.join(reached, ["lang", "before"]).select("lang", "phrase", "first", (F.col("steps") + F.col("more")).alias("steps"))
        further = open_.select("lang", F.col("phrase").alias("before"), F.col("before").alias("next"), F.col("steps").alias("more"))
        on = open_.join(further, ["lang", "before"]).select("lang", "phrase", F.col("next").alias("before"), (F.col("steps") + F.col("more")).alias("steps"))
        done, open_ = staged(done.unionByName(found), "reached"), staged(on, "links")
    ordered = done.join(edges, ["lang", "phrase"]).groupBy("lang", "first", "n").agg(
        F.array_sort(F.collect_list(F.struct("steps", _tail("phrase", 1).alias("word")))).alias("p"))
    rest = F.transform(F.slice("p", 2, F.size("p")), lambda x: x["word"])
    return ordered.select("lang", F.concat_ws(" ", F.array("first"), rest).alias("phrase"), "n", (F.size("p") + F.lit(LONGEST - 1)).alias("words"))


def _windows(paths: DataFrame, words: int) -> DataFrame:
    """The phrases of ``words`` words along the paths."""
    split = paths.select("lang", "n", F.split("phrase", " ").alias("w"))
    starts = F.sequence(F.lit(1), F.size("w") - (words - 1))
    return split.select("lang", "n", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, words), " "))).alias("phrase"))


def collocations(
    docs: DataFrame, least: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text", slots: int = SLOTS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` highest-scoring phrases of each language.

    Texts, A-Z in lower case, are split at ``.,;:!?`` and line ends into pieces, and these at spaces and tabs into words. ``n`` counts
    the words of the language; a phrase's count takes all its places within pieces, also overlapping ones. Candidates have 2 to
    LONGEST words and ``a`` >= ``least``. A cut into two parts with counts l and r scores floor(1000 a n / (l r)); the lowest cut
    counts, among equals the one with the shorter first part. A candidate that is part of a longer one of the same count is
    dropped. Equal scores are ordered by ``a``, highest first, then by the phrase's bytes.
    Null texts are empty, a null language is ``und``. Repeated rows count each; an empty table gives an empty table; other columns
    are ignored.
    """
    records = staged(gram_records(docs, least, lang_col, text_col, slots), "records")
    flow = node_flow(records)
    kept = {k: flow[k].filter(F.col("n") >= least) for k in flow}
    paths = staged(compact_paths(kept[LONGEST], kept[LONGEST - 1]), "paths")
    candidates = _windows(paths, LONGEST).select("lang", "phrase", F.col("n").alias("a"), F.lit(LONGEST).alias("words"))
    # Paths name the longest phrases around a node; below, the phrases of one more word
    around = _windows(paths, LONGEST - 1)
    for k in range(LONGEST - 1, 1, -1):
        if k < LONGEST - 1:
            longer = kept[k + 1]
            around = longer.select("lang", "n", F.explode(F.array(_head("phrase", k), _tail("phrase", k))).alias("phrase"))
        most = around.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
        own = kept[k].join(most, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.col("most") < F.col("n")))
        candidates = candidates.unionByName(own.select("lang", "phrase", F.col("n").alias("a"), F.lit(k).alias("words")))
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.expr("substring_index(phrase, ' ', cut)").alias("first"), F.expr("substring_index(phrase, ' ', cut - words)").alias("rest"))
    counts = kept[1].unionByName(kept[2]).unionByName(kept[3]).unionByName(kept[4])
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    total = staged(records.filter("words = 0").select("lang", "n"), "totals")
    valued = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(total, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    valued = valued.withColumn("over", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).withColumn("under", wide("l") * wide("r"))
    lowest = valued.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score").withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
