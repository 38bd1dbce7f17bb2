"""Divergence of sources: which sources of a language use its words most differently, and which words make a source stand out.

A first pass keeps the terms that enough documents of their language hold, exactly. The kept terms of a language are dealt over
shards, and each shard gets a minimal perfect hash: a term's bucket holds a displacement, which with the term's second hash gives
its slot among the shard's terms, without gaps. The shards are broadcast with the terms themselves. In a second pass every
group of rows counts into a dense array of slots; a term is counted where the term stored in its slot is the same. All
arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import slices, staged

#: Terms of a shard, and terms of a bucket, on average
SHARD, BUCKET = 8192, 4
#: Bytes of shards that are broadcast together; more shards take one more pass over the documents per so many bytes
PACK_BYTES = 48 << 20
#: Distinct (language, term) pairs, and counters, that a task holds before it hands them on
HELD_TERMS, HELD_CELLS = 400_000, 8 << 20
#: Sources of a language that one block of the comparison holds on each side, on average
TILE = 256
SCALE = 1_000_000_000
TOP = 10

# Letters of ASCII in lower case, bytes of other characters as they are, all else a space
_TERM = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _group(lang_col: str, source_col: str | None, text_col: str) -> list[Column]:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return [text(lang_col).alias("lang"), (text(source_col) if source_col else F.lit("")).alias("source"), text(text_col).cast("binary").alias("text")]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): in how many of the rows of a language a term occurs; a pair may be handed on several times."""
    counts: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        langs, terms, numbers = [], [], []
        for lang, found in counts.items():
            langs += [lang] * len(found)
            terms += found.keys()
            numbers += found.values()
        counts.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(terms, pa.binary()), pa.array(numbers, pa.int64())], names=["lang", "term", "n"])

    for batch in batches:
        for part in slices(batch, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                counts.setdefault(lang, Counter()).update(set(text.translate(_TERM).split()))
            if sum(map(len, counts.values())) > HELD_TERMS:
                yield flush()
    yield flush()


def kept_terms(docs: DataFrame, least: int = 10, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, term as bytes) of the terms that occur in at least ``least`` rows of their language. Null texts and languages are empty."""
    found = docs.select(*_group(lang_col, None, text_col)).mapInArrow(_frequencies, "lang string, term binary, n bigint")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")


def _hashes(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, terms)), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _slot(second: np.ndarray, shift: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Slot of a second hash under a displacement."""
    mixed = (second ^ (shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(32)) % np.uint64(size) if np.isscalar(size) else (mixed >> np.uint64(32)) % size.astype(np.uint64)).astype(np.int64)


def perfect_hash(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(displacements by bucket, slot of each term): the slots of n distinct terms are 0 to n - 1.

    A displacement below 0 stands for the slot itself, in buckets of one term. Buckets with more terms come first, largest first,
    and try displacements until all their terms fall on free slots.
    """
    n = len(terms)
    buckets = -(-n // BUCKET)
    first, second = _hashes(terms)
    if len(set(zip(first.tolist(), second.tolist()))) < n:
        raise ValueError("terms of a shard must be distinct, and so must be their 128-bit hashes")
    bucket = ((first >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    shifts, slots, taken = np.zeros(buckets, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
    single = []
    tries = np.arange(64, dtype=np.int64)
    for b in np.argsort(bounds[:-1] - bounds[1:], kind="stable").tolist():
        own = order[bounds[b] : bounds[b + 1]]
        if len(own) < 2:
            if len(own):
                single.append((b, int(own[0])))
            continue
        start = 0
        while True:
            # 64 displacements at once: fit are those whose slots are free and differ from each other
            at = np.sort(_slot(second[own][None, :], (tries + start)[:, None], n), axis=1)
            fit = np.flatnonzero(~taken[at].any(axis=1) & (at[:, 1:] != at[:, :-1]).all(axis=1))
            if len(fit):
                break
            start += 64
            if start > 1 << 28:
                raise ValueError("no displacement found")
        shifts[b] = start + fit[0]
        slots[own] = _slot(second[own], np.full(len(own), shifts[b], np.int64), n)
        taken[slots[own]] = True
    for (b, i), free in zip(single, np.flatnonzero(~taken)):
        shifts[b], slots[i] = -free - 1, free
    return shifts, slots


def _build(key: tuple, table: pa.Table) -> pa.Table:
    terms = sorted(table.column("term").to_pylist())
    shifts, slots = perfect_hash(terms)
    stored = [b""] * len(terms)
    for term, slot in zip(terms, slots.tolist()):
        stored[slot] = term
    ends = np.cumsum([len(t) for t in stored]).astype("<i4")
    return pa.table({
        "lang": pa.array([key[0].as_py()], pa.string()), "shard": pa.array([key[1].as_py()], pa.int32()), "shards": pa.array([key[2].as_py()], pa.int32()),
        "size": pa.array([len(terms)], pa.int32()), "shifts": pa.array([shifts.astype("<i4").tobytes()], pa.binary()),
        "terms": pa.array([b"".join(stored)], pa.binary()), "ends": pa.array([ends.tobytes()], pa.binary()),
    })


@F.arrow_udf(T.LongType())
def _first_hash(terms: pa.Array) -> pa.Array:
    return pa.array(_hashes(terms.to_pylist())[0].view(np.int64) if len(terms) else [], pa.int64())


def hash_shards(terms: DataFrame) -> DataFrame:
    """One row per shard of a language's terms: (lang, shard, shards, size, shifts, terms, ends); terms and their ends by slot.

    ``terms`` has the columns lang and term, without repeats. A shard has about SHARD terms, so none grows with the corpus.
    """
    count = terms.groupBy("lang").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    dealt = terms.join(count, "lang").withColumn("shard", F.pmod(_first_hash("term"), F.col("shards").cast("bigint")).cast("int"))
    return dealt.groupBy("lang", "shard", "shards").applyInArrow(
        _build, "lang string, shard int, shards int, size int, shifts binary, terms binary, ends binary")


class Lookup:
    """Slots of terms of one language, in the shards that a pack holds."""

    def __init__(self, shards: list):
        shards = sorted(shards, key=lambda s: s["shard"])
        self.count = shards[0]["shards"]
        self.row = np.full(self.count, -1, np.int64)
        self.row[[s["shard"] for s in shards]] = np.arange(len(shards))
        self.shard, self.size = np.array([s["shard"] for s in shards]), np.array([s["size"] for s in shards])
        self.base = np.concatenate([[0], np.cumsum(self.size)])
        shifts = [np.frombuffer(s["shifts"], "<i4") for s in shards]
        self.buckets = np.array([len(x) for x in shifts])
        self.shift, self.shift_base = np.concatenate(shifts).astype(np.int64), np.concatenate([[0], np.cumsum(self.buckets)])
        self.terms = b"".join(s["terms"] for s in shards)
        lengths = np.cumsum([0, *(len(s["terms"]) for s in shards)])
        ends = [np.frombuffer(s["ends"], "<i4").astype(np.int64) + at for s, at in zip(shards, lengths)]
        self.bounds = np.concatenate([[0], *ends]).tolist()

    def slots(self, terms: list[bytes]) -> np.ndarray:
        """Slot over all shards of the pack, or -1 for what is not a term of it."""
        first, second = _hashes(terms)
        row = self.row[np.mod(first.view(np.int64), self.count)]
        at = np.maximum(row, 0)
        bucket = ((first >> np.uint64(32)) % self.buckets[at].astype(np.uint64)).astype(np.int64)
        shift = self.shift[self.shift_base[at] + bucket]
        slot = np.where(shift < 0, -shift - 1, _slot(second, np.maximum(shift, 0), self.size[at])) + self.base[at]
        bounds, stored = self.bounds, self.terms
        same = [stored[bounds[s] : bounds[s + 1]] == t for s, t in zip(slot.tolist(), terms)]
        return np.where(np.array(same, bool) & (row >= 0), slot, -1)


def _recount(pack) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, source, shard, slot, n): occurrences of the pack's terms; a slot may be handed on several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookups = {lang: Lookup(shards) for lang, shards in pack.value.items()}
        dense: dict[tuple[str, str], np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in dense.items():
                found, look = np.flatnonzero(counts), lookups[lang]
                row = np.searchsorted(look.base, found, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(found), pa.string()), pa.array([source] * len(found), pa.string()),
                        pa.array(look.shard[row], pa.int32()), pa.array(found - look.base[row], pa.int32()), pa.array(counts[found], pa.int64()),
                    ],
                    names=["lang", "source", "shard", "slot", "n"],
                )
            dense.clear()

        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                groups: dict[tuple[str, str], list[bytes]] = {}
                for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text"))):
                    if lang in lookups:
                        groups.setdefault((lang, source), []).append(text)
                for group, texts in groups.items():
                    counted = Counter(b" ".join(texts).translate(_TERM).split())
                    if not counted:
                        continue
                    look = lookups[group[0]]
                    slot = look.slots(list(counted))
                    known = slot >= 0
                    if group not in dense:
                        if dense and sum(map(len, dense.values())) + look.base[-1] > HELD_CELLS:
                            yield from flush()
                        dense[group] = np.zeros(look.base[-1], np.int64)
                    dense[group][slot[known]] += np.fromiter(counted.values(), np.int64, len(counted))[known]
        yield from flush()

    return run


def recount(docs: DataFrame, shards: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, shard, slot, n) with the exact number of occurrences of every kept term in every group that has any.

    The shards are broadcast in packs of PACK_BYTES, each with a pass over the documents, so memory does not grow with their number.
    ``shards`` is read several times; pass a written table.
    """
    spark = docs.sparkSession
    sizes = shards.select("lang", "shard", (F.length("terms") + F.length("ends") + F.length("shifts")).alias("bytes")).orderBy("lang", "shard").collect()
    packs, held = [[]], 0
    for s in sizes:
        if packs[-1] and held + s["bytes"] > PACK_BYTES:
            packs.append([])
            held = 0
        packs[-1].append(s)
        held += s["bytes"]
    rows = docs.select(*_group(lang_col, source_col, text_col))
    schema = "lang string, source string, shard int, slot int, n bigint"
    found = spark.createDataFrame([], schema)
    for pack in filter(None, packs):
        first, last = pack[0], pack[-1]
        place = F.struct("lang", "shard")
        inside = shards.filter((place >= F.struct(F.lit(first["lang"]), F.lit(first["shard"]))) & (place <= F.struct(F.lit(last["lang"]), F.lit(last["shard"]))))
        by_lang: dict[str, list] = {}
        for s in inside.toLocalIterator():
            by_lang.setdefault(s["lang"], []).append(s.asDict() | {c: bytes(s[c]) for c in ("shifts", "terms", "ends")})
        found = found.unionByName(rows.mapInArrow(_recount(spark.sparkContext.broadcast(by_lang)), schema))
    return found.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))


def share(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * counts / total) for 0 <= counts <= total, by long division in base 1000: nothing passes 64 bits."""
    out, rest = np.zeros_like(counts), counts
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _compare(key: tuple, counts: pa.Table, meta: pa.Table) -> pa.Table:
    """Partial values of one block: a shard's terms, the sources of tile i against those of tile j."""
    info = meta.to_pylist()[0]
    lang, i, j = key[0].as_py(), key[2].as_py(), key[3].as_py()
    size, smoothed = info["size"], 2 * info["kept"]
    tile, at, slot, n = (counts.column(c).to_numpy() for c in ("tile", "at", "slot", "n"))

    def side(t: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        names, totals = ([s[c] for s in info[f"sources_{'i' if t == i else 'j'}"]] for c in ("source", "total"))
        dense = np.zeros((len(names), size), np.int64)
        own = (tile == t) & (at >= 0)
        dense[at[own], slot[own]] = n[own]
        return names, dense, share(dense + 2, np.array(totals, np.int64)[:, None] + smoothed)

    source, part, item, value = [], [], [], []

    def add(a: str, kind: str, b: str, v: int) -> None:
        source.append(a)
        part.append(kind)
        item.append(b)
        value.append(int(v))

    names, dense, p = side(i)
    others, _, q = (names, dense, p) if i == j else side(j)
    for x, name in enumerate(names):
        after = x + 1 if i == j else 0
        for other, v in zip(others[after:], _distance(p[x], q[after:]).sum(axis=1)):
            add(name, "pair", other, v)
            add(other, "pair", name, v)
    if i == j:
        whole = np.zeros(size, np.int64)
        own = at < 0
        whole[slot[own]] = n[own]
        base = share(whole + 2, info["total"] + smoothed)
        bounds = [0, *np.frombuffer(info["ends"], "<i4").tolist()]
        terms = [info["terms"][a:b] for a, b in zip(bounds, bounds[1:])]
        place = np.empty(size, np.int64)
        place[sorted(range(size), key=terms.__getitem__)] = np.arange(size)
        for x, name in enumerate(names):
            above = np.flatnonzero((dense[x] > 0) & (p[x] > base))
            values = _distance(p[x][above], base[above])
            # Only a block's first TOP can be among the group's first TOP
            for k in np.lexsort((place[above], -values))[:TOP]:
                add(name, "term", terms[above[k]].decode("utf-8", "replace"), values[k])
    return pa.table({
        "lang": pa.array([lang] * len(source), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()),
        "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64()),
    })


def audit(docs: DataFrame, least: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) per (lang, source) group; ``rank`` counts from 1 within group and part, highest value first.

    Terms are runs of ASCII letters and other characters above ASCII, A-Z in lower case; a language keeps those in at least
    ``least`` of its rows. With a group's count of a kept term, N the sum of its counts and V the number of kept terms,
    p = 1 + floor(10^9 * (count + 2) / (N + 2 V)), and f = floor((p - q)^2 / (p + q)).
    Part ``pair``: item is every other source of the language, value the sum of f over all kept terms (0 without any).
    Part ``term``: item is a kept term that the group holds and uses more than the whole language does, q being the language's p;
    the TOP highest. Equal values are ordered by the item's bytes.
    Null texts, languages and sources are empty strings. Groups without any term are compared like others. Repeated rows count
    each; an empty table gives an empty table; other columns are ignored.
    """
    shards = staged(hash_shards(staged(kept_terms(docs, least, lang_col, text_col), "terms")), "shards")
    counts = staged(recount(docs, shards, lang_col, source_col, text_col), "counts")
    groups = docs.select(*_group(lang_col, source_col, text_col)[:2]).distinct()
    totals = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").withColumn(
        "total", F.coalesce("total", F.lit(0)))
    langs = totals.groupBy("lang").agg(F.sum("total").alias("total"), F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).join(
        shards.groupBy("lang").agg(F.sum("size").alias("kept")), "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    langs = staged(langs, "langs")
    dealt = totals.join(langs.select("lang", "tiles"), "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    at = F.row_number().over(Window.partitionBy("lang", "tile").orderBy("source")) - 1
    placed = staged(dealt.select("lang", "source", "total", "tile", at.alias("at")), "groups")
    tiles = placed.groupBy("lang", "tile").agg(F.array_sort(F.collect_list(F.struct("at", "source", "total"))).alias("sources"))
    side = lambda x: tiles.select("lang", F.col("tile").alias(x), F.col("sources").alias(f"sources_{x}"))
    blocks = shards.join(langs, "lang").join(side("i"), "lang").join(side("j"), "lang").filter("i <= j").select(
        "lang", "shard", "i", "j", "size", "terms", "ends", "total", "kept", "sources_i", "sources_j")
    # Counts of a tile go to every block that compares it, those of the whole language to the blocks of a tile with itself
    upto = F.sequence(F.lit(0), F.col("tiles") - 1)
    own = counts.join(placed.select("lang", "source", "tile", "at"), ["lang", "source"]).join(langs.select("lang", "tiles"), "lang").withColumn("_t", F.explode(upto)).select(
        "lang", "shard", F.least("tile", "_t").alias("i"), F.greatest("tile", "_t").alias("j"), "tile", "at", "slot", "n")
    whole = counts.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("n")).join(langs.select("lang", "tiles"), "lang").withColumn("_t", F.explode(upto)).select(
        "lang", "shard", F.col("_t").alias("i"), F.col("_t").alias("j"), F.col("_t").alias("tile"), F.lit(-1).alias("at"), "slot", "n")
    place = ["lang", "shard", "i", "j"]
    schema = "lang string, source string, part string, item string, value bigint"
    compared = own.unionByName(whole).groupBy(*place).cogroup(blocks.groupBy(*place)).applyInArrow(_compare, schema)
    bare = placed.join(langs.filter("kept = 0").select("lang"), "lang", "left_semi")
    none = bare.select("lang", "source").join(bare.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("bigint").alias("value"))
    valued = compared.unionByName(none).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = valued.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= TOP))
