"""Byte-level BPE: encode whole texts by a rank file, decode ids back to bytes.

Each match of the split pattern is merged by itself. A segment tree over its byte positions holds, for every live token
start, the rank of the pair it forms with its right neighbour; inner nodes hold the smallest rank and, among equals,
the leftmost position. A merge reads the root, joins two neighbours and updates three leaves, so a piece of n bytes costs
O(n log n) however long it is.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import per_text

#: Pieces, and their bytes, remembered per task before starting anew (about 50 MB)
REMEMBERED, REMEMBERED_BYTES = 120_000, 16 << 20
#: Bytes of text that one step encodes, and ids that one step decodes
STEP_BYTES, STEP_IDS = 1 << 20, 1 << 18
#: Longest piece in bytes that is merged in groups of one length
LONGEST = 48


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece; bytes without a rank of their own raise KeyError."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    shift = n.bit_length()
    mask, never = (1 << shift) - 1, 1 << 62
    leaves = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [never] * (2 * leaves)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    find = ranks.get
    for i in range(n - 1):
        rank = find(piece[i : i + 2])
        if rank is not None:
            tree[leaves + i] = rank << shift | i
    for i in range(leaves - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left < right else right

    def put(i: int, key: int) -> None:
        i += leaves
        tree[i] = key
        while i > 1:
            other = tree[i ^ 1]
            if other < key:
                key = other
            i >>= 1
            if tree[i] == key:
                return
            tree[i] = key

    def pair(i: int) -> int:
        j = after[i]
        if j >= n:
            return never
        rank = find(piece[i : after[j]])
        return never if rank is None else rank << shift | i

    while tree[1] < never:
        i = tree[1] & mask
        j = after[i]
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        if j < n - 1:
            put(j, never)
        if i < n - 1:
            put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Merges:
    """The same segment trees for many pieces of one length at once, a row per piece."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = [
            (ranks[token[:k]] << 32 | ranks[token[k:]], rank)
            for token, rank in ranks.items() for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks
        ]
        self.keys, self.made = (np.array(x, np.int64) for x in zip(*sorted(pairs))) if pairs else (np.zeros(0, np.int64),) * 2

    def _leaf(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, shift: int, never: int) -> np.ndarray:
        """Keys of the pairs (a, b) that start at ``at``; a or b below 0 means that there is no such token."""
        if not len(self.keys):
            return np.full(len(a), never, np.int64)
        key = a << 32 | b
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[place] == key) & (a >= 0) & (b >= 0)
        return np.where(known, self.made[place] << shift | at, never)

    def ids(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pieces of one and the same length above 1."""
        n, count = len(pieces[0]), len(pieces)
        shift, never = n.bit_length(), 1 << 62
        leaves = 1 << (n - 1).bit_length()
        tokens = np.full((count, n + 1), -1, np.int64)
        tokens[:, :n] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8).reshape(count, n)]
        if tokens[:, :n].min() < 0:
            raise KeyError("a byte has no rank")
        after = np.tile(np.arange(1, n + 2, dtype=np.int64), (count, 1))
        before = np.tile(np.arange(-1, n, dtype=np.int64), (count, 1))
        live = np.ones((count, n), bool)
        tree = np.full((count, 2 * leaves), never, np.int64)
        starts = np.tile(np.arange(n - 1, dtype=np.int64), count)
        tree[:, leaves : leaves + n - 1] = self._leaf(
            tokens[:, : n - 1].ravel(), tokens[:, 1:n].ravel(), starts, shift, never).reshape(count, n - 1)
        width = leaves
        while width > 1:
            half = width // 2
            tree[:, half:width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
            width = half
        rows = np.flatnonzero(tree[:, 1] < never)
        while len(rows):
            root = tree[rows, 1]
            i = root & ((1 << shift) - 1)
            j = after[rows, i]
            k = after[rows, j]
            tokens[rows, i] = root >> shift
            live[rows, j] = False
            after[rows, i] = k
            before[rows, k] = i
            p = before[rows, i]
            tree[rows, leaves + j] = never
            tree[rows, leaves + i] = self._leaf(tokens[rows, i], tokens[rows, k], i, shift, never)
            has = p >= 0
            own, q = rows[has], p[has]
            tree[own, leaves + q] = self._leaf(tokens[own, q], tokens[own, i[has]], q, shift, never)
            for r, node in ((rows, leaves + j), (rows, leaves + i), (own, leaves + q)):
                while node[:1].size and node[0] > 1:
                    node = node >> 1
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            rows = rows[tree[rows, 1] < never]
        flat = tokens[:, :n][live].tolist()
        ends = np.cumsum(live.sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]


class _Codes(dict):
    """Piece -> running number; ``fresh`` collects the pieces not seen before."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = code = len(self)
        self.fresh.append(piece)
        return code


class Pieces:
    """Ids of pieces, remembered up to a bound; new short pieces are merged in groups of one length."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.merges = ranks, Merges(ranks)
        self._forget()

    def _forget(self) -> None:
        self.codes, self.weight = _Codes(), 0
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, fresh: list[str]) -> None:
        found: list[tuple[int, ...] | list[int]] = [()] * len(fresh)
        groups = defaultdict(list)
        for k, piece in enumerate(fresh):
            raw = piece.encode()
            whole = self.ranks.get(raw)
            self.weight += len(raw)
            if whole is not None:
                found[k] = (whole,)
            elif len(raw) <= LONGEST:
                groups[len(raw)].append((k, raw))
            else:
                found[k] = merge(raw, self.ranks)
        for group in groups.values():
            for i in range(0, len(group), 4096):
                part = group[i : i + 4096]
                for (k, _), ids in zip(part, self.merges.ids([raw for _, raw in part])):
                    found[k] = ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))])

    def encode(self, texts: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and the count of each text."""
        if len(self.codes) >= REMEMBERED or self.weight >= REMEMBERED_BYTES:
            self._forget()
        coded = [np.fromiter(map(self.codes.__getitem__, pieces), np.int64, len(pieces)) for pieces in texts]
        if self.codes.fresh:
            self._learn(self.codes.fresh)
            self.codes.fresh = []
        every = np.concatenate(coded) if coded else np.empty(0, np.int64)
        sizes = self.size[every]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.start[every] - ends + sizes, sizes)]
        stops = np.concatenate([[0], ends])[np.cumsum([0] + [len(c) for c in coded])]
        return ids, np.diff(stops)


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
    verify: bool = False,
) -> DataFrame:
    """(id_col, further columns ``keep``, ids array<int>) per row: the ids of the whole text, without special tokens.

    With ``verify`` also round_trip boolean: whether the ids, decoded again, are the bytes of the text.

    Null and empty texts give an empty array. Repeated rows give repeated results. ``pattern`` is in the syntax of the
    ``regex`` module; text that no match covers is left out, as the public patterns cover everything.
    ``ranks_path`` must be readable on the executors.
    """

    def make():
        ranks = load_ranks(ranks_path)
        pieces, split, vocabulary = Pieces(ranks), regex.compile(pattern).findall, Vocabulary(ranks)

        def compute(texts: list[bytes]) -> list[pa.Array]:
            flat, counts = pieces.encode(split(text.decode("utf-8", "replace")) for text in texts)
            ends = np.concatenate([[0], np.cumsum(counts)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            if not verify:
                return [ids]
            return [ids, pa.compute.equal(vocabulary.bytes_of(ids), pa.array(texts, pa.binary()))]

        return compute

    added = "ids array<int>" + ", round_trip boolean" * verify
    return per_text(docs, text_col, [id_col, *(keep or [])], added, make, STEP_BYTES)


class Vocabulary:
    """Bytes of ids, as one block that is gathered from."""

    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values(), default=-1) + 1
        self.start, self.size = np.zeros(top + 1, np.int64), np.full(top + 1, -1, np.int64)
        at = 0
        for token, rank in ranks.items():
            self.start[rank], self.size[rank] = at, len(token)
            at += len(token)
        self.block = np.frombuffer(b"".join(ranks), np.uint8)

    def bytes_of(self, ids: pa.ListArray) -> pa.Array:
        """Bytes of every list; null for a null list or one that holds an unknown or null id."""
        offsets = ids.offsets.to_numpy().astype(np.int64)
        values = ids.values.slice(offsets[0], offsets[-1] - offsets[0]).fill_null(-1).to_numpy()
        offsets = offsets - offsets[0]
        known = np.where((values >= 0) & (values < len(self.size) - 1), values, len(self.size) - 1)
        sizes = self.size[known]
        faults = np.concatenate([[0], np.cumsum(sizes < 0)])
        sizes = np.maximum(sizes, 0)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        data = self.block[np.arange(total) + np.repeat(self.start[known] - ends + sizes, sizes)]
        bounds = np.concatenate([[0], ends])[offsets].astype(np.int32)
        whole = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        sound = (faults[offsets[1:]] == faults[offsets[:-1]]) & ids.is_valid().to_numpy(zero_copy_only=False)
        return pa.compute.if_else(pa.array(sound), whole, pa.scalar(None, pa.binary()))


def decode(ids: Column, ranks_path: str) -> Column:
    """Bytes of an array of ids; null for a null array or one that holds an unknown or null id."""

    @F.arrow_udf("binary")
    def to_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = Vocabulary(load_ranks(ranks_path))
        for batch in batches:
            offsets, parts, start = batch.offsets.to_numpy(), [], 0
            while start < len(batch):
                stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + STEP_IDS, "right")) - 1)
                parts.append(vocabulary.bytes_of(batch.slice(start, stop - start)))
                start = stop
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return to_bytes(ids.cast("array<int>"))
