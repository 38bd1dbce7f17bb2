"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents become pieces of at most ``size`` tokens. Every partition packs its pieces best-fit, longest first, and emits the bins
that are nearly full. The others become items of their own, with their fill as their length; a tree of partitions merges them
and packs again, until one node is left. A node carries at most CARRIED bins and so stays small however large the corpus is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import per_text, staged

#: Pieces that one local round packs together
LOCAL = 1 << 16
#: Partitions or nodes that one node of the tree merges, and the bins it hands on at most, the emptiest ones
FAN_IN, CARRIED = 8, 2048
#: A bin with so few free places, as a share of its length, is emitted
NEARLY_FULL = 1 / 256
#: Pattern of a byte-level pre-tokenizer without settings of its own
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space of this length overruns the stack of the faster library
_LONG_SPACE = re.compile(r"\s{2000}")
#: Bytes of text that one step encodes
STEP_BYTES = 1 << 20

_BINS = "closed boolean, node bigint, fill int, keys array<bigint>, lengths array<int>"


def _characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids, without special tokens, by the vocabulary file at ``path``.

    A byte-level vocabulary whose ids are its merge order is encoded by ``tiktoken``, which gives the same ids several times
    faster; other vocabularies, and texts with very long white space, by ``tokenizers``.
    """
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True

    def by_tokenizers(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    model, split = data["model"], data.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True)
        and not split.get("add_prefix_space") and not data.get("normalizer") and not model.get("ignore_merges")
    )
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
    if not plain or any(model["vocab"].get(token) != 256 + i for i, token in enumerate(merged)):
        return by_tokenizers
    byte = _characters()
    special = {x["content"] for x in data["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def by_ranks(text: str) -> np.ndarray:
        if _LONG_SPACE.search(text):
            return by_tokenizers(text)
        return fast.encode_to_numpy(text, disallowed_special=())

    return by_ranks


def _cut(ids: np.ndarray, size: int) -> list[int]:
    """Bounds of the pieces: all but the first have ``size`` tokens."""
    first = len(ids) % size or min(size, len(ids))
    return [0, *range(first, len(ids) + 1, size)] if len(ids) else []


def pieces(
    docs: DataFrame, vocabulary: str, size: int = 1024, end: int | None = 2, id_col: str = "doc_id", text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """(id_col, further columns ``keep``, piece, start, length, ids) of every piece of every document.

    ``ids`` are the token ids as little-endian unsigned 32-bit numbers; the id ``end`` follows the last token of a document (None:
    nothing follows). Only longer documents are cut, into pieces of ``size`` tokens, of which the first may be shorter.
    Null and empty texts are the end id alone; without an end id they have no piece. Repeated rows give repeated pieces.
    ``vocabulary`` must be readable on the executors.
    """

    def make():
        encode = encoder(vocabulary)

        def compute(texts: list[bytes]) -> list[pa.Array]:
            rows, starts, lengths, numbers, blobs = [0], [], [], [], []
            for text in texts:
                ids = encode(text.decode("utf-8", "replace"))
                if end is not None:
                    ids = np.append(ids, np.uint32(end))
                bounds = _cut(ids, size)
                raw = ids.astype("<u4").tobytes()
                for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    numbers.append(i)
                    starts.append(a)
                    lengths.append(b - a)
                    blobs.append(raw[4 * a : 4 * b])
                rows.append(len(numbers))
            made = pa.StructArray.from_arrays(
                [pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(blobs, pa.binary())],
                names=["piece", "start", "length", "ids"],
            )
            return [pa.ListArray.from_arrays(pa.array(rows, pa.int32()), made)]

        return compute

    kept = [id_col, *(keep or [])]
    found = per_text(docs, text_col, kept, "_pieces array<struct<piece:int,start:bigint,length:bigint,ids:binary>>", make, STEP_BYTES)
    return found.select(*[found[c] for c in kept], F.explode("_pieces").alias("_piece")).select(*kept, "_piece.*")


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins as lists of positions in ``lengths``: longest first, each into the fullest bin that has room for it."""
    open_bins: list[list[list[int]]] = [[] for _ in range(size + 1)]
    bins: list[list[int]] = []
    # Bit r is set while some bin has r free places, so the lowest bit from the item's length on is the best fit
    free = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                free &= ~(1 << room)
        else:
            room, chosen = size, []
            bins.append(chosen)
        chosen.append(i)
        if room > n:
            open_bins[room - n].append(chosen)
            free |= 1 << (room - n)
    return bins


def _round(items: list[tuple[np.ndarray, np.ndarray]], size: int, last: bool) -> tuple[list[tuple], list[tuple]]:
    """Pack items, each the keys and lengths of its members, into bins of the same form: those emitted, those carried on."""
    fills = np.array([x.sum() for _, x in items], np.int64)
    bins = best_fit(fills, size)
    totals = np.array([fills[b].sum() for b in bins], np.int64)
    carried = np.flatnonzero(totals < size - int(size * NEARLY_FULL))
    carried = carried[np.argsort(totals[carried], kind="stable")[: 0 if last else CARRIED]]
    made = [tuple(np.concatenate([items[i][side] for i in b]) for side in (0, 1)) for b in bins]
    on = set(carried.tolist())
    return [x for i, x in enumerate(made) if i not in on], [made[i] for i in carried]


def _rows(bins: list[tuple], node: int, closed: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([closed] * len(bins), pa.bool_()), pa.array([node] * len(bins), pa.int64()),
            pa.array([x.sum() for _, x in bins], pa.int32()),
            pa.array([k for k, _ in bins], pa.list_(pa.int64())), pa.array([x for _, x in bins], pa.list_(pa.int32())),
        ],
        names=["closed", "node", "fill", "keys", "lengths"],
    )


def _local(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rounds over a partition: each takes LOCAL pieces and the bins that the round before carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, items, fresh = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, LOCAL):
                part = batch.slice(start, LOCAL)
                keys, lengths = (c.to_numpy() for c in part.columns)
                items += [(keys[i : i + 1], lengths[i : i + 1]) for i in range(len(keys))]
                fresh += len(keys)
                if fresh >= LOCAL:
                    emitted, items = _round(items, size, False)
                    fresh = 0
                    yield _rows(emitted, node, True)
        emitted, items = _round(items, size, False)
        yield _rows(emitted, node, True)
        yield _rows(items, node, False)

    return run


def _merge(size: int, last: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("fill", "descending"), ("first", "ascending")])
        items = list(zip(*(map(np.array, table.column(c).to_pylist()) for c in ("keys", "lengths"))))
        emitted, carried = _round(items, size, last)
        return pa.Table.from_batches([_rows(emitted, key[0].as_py(), True), _rows(carried, key[0].as_py(), False)])

    return run


def pack(cut: DataFrame, size: int = 1024, key: str = "piece_key", length: str = "length") -> DataFrame:
    """The rows of ``cut`` with sequence_id and offset: pieces of one sequence lie one behind the other, from 0 on, without gaps.

    ``key`` must be unique and not null, ``length`` between 1 and ``size``; ``cut`` is read several times, so pass a written table.
    An empty table gives an empty table. Equal lengths are settled by key, and a sequence is named by the key of its first piece.
    """
    whole = cut.filter(F.col(length) >= size).select(F.col(key).alias("key"), F.col(key).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    items = cut.filter(F.col(length) < size).select(F.col(key).cast("bigint").alias("key"), F.col(length).cast("int").alias("length"))
    bins = staged(items.mapInArrow(_local(size), _BINS), "bins")
    emitted, nodes = [bins.filter("closed")], bins.filter("not closed").agg(F.max("node") + 1).first()[0]
    while nodes:
        nodes = -(-nodes // FAN_IN) if nodes > 1 else 0
        parents = bins.filter("not closed").withColumn("node", F.floor(F.col("node") / FAN_IN)).withColumn("first", F.element_at("keys", 1))
        bins = staged(parents.groupBy("node").applyInArrow(_merge(size, nodes <= 1), _BINS), "bins")
        emitted.append(bins.filter("closed"))
        nodes = 0 if nodes <= 1 else nodes
    placed = whole
    for part in emitted:
        before = F.transform("lengths", lambda _, i: F.aggregate(F.slice("lengths", 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x))
        each = part.select(F.element_at("keys", 1).alias("sequence_id"), F.explode(F.arrays_zip(F.col("keys").alias("key"), before.alias("offset"))).alias("_m"))
        placed = placed.unionByName(each.select("_m.key", "sequence_id", "_m.offset"))
    return cut.join(placed.withColumnRenamed("key", key), key)


def pack_documents(
    docs: DataFrame, vocabulary: str, size: int = 1024, end: int | None = 2, id_col: str = "doc_id", text_col: str = "text",
    digest: bool = False,
) -> DataFrame:
    """``pieces`` of the documents with sequence_id and offset. With ``digest`` the column ids_crc32 stands in place of the ids."""
    cut = pieces(docs, vocabulary, size, end, id_col, text_col)
    if digest:
        cut = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(staged(cut.withColumn("piece_key", F.monotonically_increasing_id()), "pieces"), size).drop("piece_key")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths) per sequence: the ids of its pieces one behind the other, and the pieces' lengths."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    return rows.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x["length"]).alias("lengths"))
