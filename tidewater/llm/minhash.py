"""Near-duplicate documents: MinHash banding, signature verification, full-set confirmation, components.

A document's set is the distinct word shingles of its whole text. Documents with equal sets form one class, so
exact copies are settled by one aggregation. Each class gets many universal hash minima; ``rows`` consecutive minima
make a band, and classes that share a band are candidates.

Candidates of one band bucket are never expanded into all pairs:

1. every member meets the bucket's smallest member; these pairs are verified on the signature and confirmed on the full
   sets, and the links give first components;
2. where a bucket still spans several components, the members outside its largest component meet all members, block by
   block, on their full sets inside one task, which returns at most a spanning forest.

A pair is missed only if no band agrees, with probability (1 - s**ROWS)**bands at similarity s. There are as many bands as
bring this below MISSED at the threshold (24 for 0.85, 35 for 0.8); above it the probability falls fast.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import per_row, per_text, staged

MISSED, ROWS = 1e-6, 5
#: Signature shares more than five standard deviations below the threshold are rejected without the full sets
SIGMAS = 5.0
#: Sides of one block of step 2
OUTSIDERS, MEMBERS = 256, 1024
#: Candidate ids up to this number (8 MB) are broadcast to read their texts again, else joined by a shuffle
BROADCAST_IDS = 1 << 20
_VOCABULARY = 1 << 17

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _VOCABULARY:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingler(width: int) -> Callable[[bytes], np.ndarray]:
    """UTF-8 text -> sorted distinct 64-bit shingle hashes. ``bytes.lower`` maps A-Z only and ``bytes.split`` cuts at
    space and \\t..\\r only, as the definition of a word asks; fewer words than ``width`` make one shingle."""
    words = _Words()

    def shingles(text: bytes) -> np.ndarray:
        parts = text.lower().split()
        if not parts:
            return np.empty(0, np.uint64)
        if len(parts) < width:
            return np.array([xxhash.xxh64_intdigest(b" ".join(parts), seed=len(parts))], np.uint64)
        h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
        n = len(parts) - width + 1
        x = np.zeros(n, np.uint64)
        for k in range(width):
            x = (x ^ (x >> np.uint64(29))) * _MIX[k % len(_MIX)] + h[k : k + n]
        x ^= x >> np.uint64(32)
        x *= _MIX[3]
        x ^= x >> np.uint64(29)
        return np.unique(x)

    return shingles


def hash_family(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add-shift hashes h(x) = (a x + b mod 2^64) >> 32 with odd a."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, count, dtype=np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(shingles), 512):
        x = shingles[None, i : i + 512] * a[:, None]
        x += b[:, None]
        np.minimum(best, x.min(axis=1) >> np.uint64(32), out=best)
    return best.astype(np.uint32)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    """(id, n_shingles, k1, k2, minima, bands) per row; k1, k2 identify the set, both null when it is empty."""

    def make():
        shingles, (a, b) = shingler(width), hash_family(bands * rows, seed)

        def compute(texts: list[bytes]) -> list[pa.Array]:
            sizes, low, high, mins, keyed = [], [], [], [], []
            for text in texts:
                x = shingles(text)
                sizes.append(len(x))
                if not len(x):
                    low.append(None), high.append(None), mins.append(None), keyed.append(None)
                    continue
                digest = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                low.append(int.from_bytes(digest[:8], "little", signed=True)), high.append(int.from_bytes(digest[8:], "little", signed=True))
                raw = minima(x, a, b).tobytes()
                mins.append(raw)
                bits = [xxhash.xxh64_digest(raw[k * rows * 4 : (k + 1) * rows * 4], seed=k + 1) for k in range(bands)]
                keyed.append(np.frombuffer(b"".join(bits), np.int64))
            longs = [pa.array(v, pa.int64()) for v in (sizes, low, high)]
            return [*longs, pa.array(mins, pa.binary()), pa.array(keyed, pa.list_(pa.int64()))]

        return compute

    return per_text(_identified(docs, id_col, text_col), "text", ["id"], "n_shingles bigint, k1 bigint, k2 bigint, minima binary, bands array<bigint>", make)


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, shingles) per row."""

    def make():
        shingles = shingler(width)
        return lambda texts: [pa.array([shingles(t).view(np.int64) for t in texts], pa.list_(pa.int64()))]

    return per_text(_identified(docs, id_col, text_col), "text", ["id"], "shingles array<bigint>", make)


def similar(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def _confirm(percent: int, hashes: int):
    """Pairs (a, b) with both signatures and sets -> those that are links."""
    s = percent / 100
    least = hashes * (s - SIGMAS * (s * (1 - s) / hashes) ** 0.5)

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            keep = []
            left, right = batch.column("set_a"), batch.column("set_b")
            for i, (x, y) in enumerate(zip(batch.column("min_a").to_pylist(), batch.column("min_b").to_pylist())):
                if (np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).sum() < least:
                    continue
                p, q = left[i].values.to_numpy(), right[i].values.to_numpy()
                if similar(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), percent):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

        return step

    return make


def _forest(percent: int):
    """One block of step 2 -> links that join components not yet joined within the block."""

    def join(table: pa.Table) -> pa.Table:
        ids, comps = table.column("id").to_numpy(), table.column("component").to_pylist()
        out = np.asarray(table.column("outside").to_pylist(), bool)
        lists = table.column("shingles").combine_chunks()
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        _, codes = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        sizes, parent = np.diff(offsets), {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        members = np.flatnonzero(~out)
        if not len(members):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        starts = np.concatenate([[0], np.cumsum(sizes[members])[:-1]])
        held = np.concatenate([codes[offsets[m] : offsets[m + 1]] for m in members])
        mark, links = np.zeros(len(codes) + 1, bool), []
        for x in np.flatnonzero(out):
            own = codes[offsets[x] : offsets[x + 1]]
            mark[own] = True
            shared = np.add.reduceat(mark[held].astype(np.int64), starts)
            mark[own] = False
            for k in np.flatnonzero(100 * shared >= percent * (sizes[x] + sizes[members] - shared)):
                p, q = find(comps[x]), find(comps[members[k]])
                if p != q:
                    parent[p] = q
                    links.append((int(ids[x]), int(ids[members[k]])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return join


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80,
    bands: int | None = None, rows: int = ROWS, seed: int = 20240,
) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id (smallest linked id, itself included), kept.

    ``bands`` is derived from the threshold (below 100 percent) unless given.
    Two documents are linked when 100 * |A & B| >= ``percent`` * |A | B| over their distinct ``width``-word shingles
    (words are runs other than ASCII white space, A-Z lower-cased; shorter texts are one shingle).
    Null, empty and white-space-only texts have an empty set and link with nothing. Rows that share an id are one node.
    A null id can't name a component: such a row has a null component_id and is kept. Other columns are ignored.
    """
    bands = bands or math.ceil(math.log(MISSED) / math.log(1 - min(percent / 100, 0.99) ** rows))
    sig = staged(signatures(docs, id_col, text_col, width, bands, rows, seed), "signatures")
    valued = sig.filter("k1 is not null and id is not null")
    # Equal sets are one class, named by its smallest id
    named = staged(valued.groupBy("k1", "k2").agg(F.min("id").alias("rep")), "named")
    classes = staged(
        valued.join(named.select("k1", "k2", F.col("rep").alias("id")), ["k1", "k2", "id"], "left_semi")
        .select("id", "n_shingles", "minima", "bands").dropDuplicates(["id", "bands"]), "classes",
    )
    # Buckets with the same members in several bands count once
    spread = classes.select("id", F.explode("bands").alias("key"))
    size = spread.groupBy("key").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"), F.min("id").alias("center")
    ).filter("n > 1")
    once = staged(size.groupBy("n", "h", "center").agg(F.min("key").alias("key")).select("key", "center"), "buckets")
    members = staged(spread.join(once, "key").select("key", "center", "id"), "members")
    nodes = staged(members.select("id").distinct(), "candidates")
    few = nodes.count() <= BROADCAST_IDS
    texts = docs.withColumn(id_col, F.col(id_col).cast("bigint")).join(
        (F.broadcast(nodes) if few else nodes).select(F.col("id").alias(id_col)), id_col, "left_semi"
    )
    own = shingle_sets(texts, id_col, text_col, width)
    sets = staged(
        own.join(classes.select("id", "n_shingles", "minima"), "id").filter(F.size("shingles") == F.col("n_shingles"))
        .dropDuplicates(["id", "minima"]), "sets",
    )
    # Step 1: members against the bucket's smallest member
    pairs = members.filter("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}"), F.col("minima").alias(f"min_{x}"))
    first = staged(per_row(pairs.join(side("a"), "a").join(side("b"), "b"), "a bigint, b bigint", _confirm(percent, bands * rows)), "links")
    # An id that has several texts is one node: it links their classes
    again = valued.groupBy("id").agg(F.countDistinct("k1", "k2").alias("n")).filter("n > 1").select("id")
    alike = valued.join(again, "id", "left_semi").join(named, ["k1", "k2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    grouped = staged(connected_components(first.unionByName(alike), "a", "b"), "components")
    # Step 2: buckets that still span several components
    placed = members.select("key", "id").join(grouped.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    counts = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
    open_keys = counts.groupBy("key").agg(
        F.max(F.struct("c", "component"))["component"].alias("main"), F.max("c").alias("top"), F.sum("c").alias("n"), F.count("*").alias("k"),
    ).filter("k > 1").select(
        "key", "main", F.ceil((F.col("n") - F.col("top")) / OUTSIDERS).alias("n_out"), F.ceil(F.col("n") / MEMBERS).alias("n_all"),
    )
    opened = staged(placed.join(open_keys, "key"), "open")
    cell = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.col(n))
    outside = opened.filter("component <> main").select(
        "key", "id", "component", cell("n_out", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j"), F.lit(True).alias("outside"))
    inside = opened.select(
        "key", "id", "component", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("i"), cell("n_all", 2).alias("j"), F.lit(False).alias("outside"))
    blocks = outside.unionByName(inside).join(sets.select("id", "shingles"), "id")
    more = blocks.groupBy("key", "i", "j").applyInArrow(_forest(percent), "a bigint, b bigint")
    of = lambda x: grouped.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = connected_components(joined, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("final"))
    # Classes -> components -> rows. Rows that share an id join the classes of all their texts
    by_class = named.select("k1", "k2", F.col("rep").alias("node")).join(grouped, "node", "left").withColumn(
        "component", F.coalesce("component", "node")).join(merged, "component", "left")
    # Written, so that the rows of a large group of copies meet it in a plain join, which can split them
    final = staged(by_class.select("k1", "k2", F.coalesce("final", "component").alias("component_id")), "final")
    return sig.join(final, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )
