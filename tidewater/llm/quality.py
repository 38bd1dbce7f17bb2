"""Document quality by a regularised quadratic discriminant over transformed document statistics.

Training needs only counts, sums and cross products per class, so every labelled row counts and nothing but a few hundred
sums reaches the driver. Class covariances are shrunk towards the pooled one and towards the identity; their Cholesky
factors are computed once and travel with the scoring function.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import per_row, per_text

FEATURES = [
    "chars", "words", "word_length", "word_spread", "letters", "upper", "digits", "marks", "symbols", "symbol_ends", "shouts",
    "distinct", "top_word", "stutter", "repeated_lines", "byte_entropy", "repeated_grams",
]
#: Added to the whole of which a share is taken
DAMPING = 12.0
#: Weight of the pooled covariance, then of the scaled identity
TO_POOLED, TO_IDENTITY = 0.2, 0.05
#: Log-odds are divided by this: statistics of one text are correlated, so plain log-odds are overconfident
TEMPERATURE = 4.0

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 192)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_MARK = np.isin(_BYTES, list(b".,;:!?'\"()-"))
_SYMBOL = (_BYTES > 32) & (_BYTES < 127) & ~(_LETTER | _DIGIT | _MARK)
_CLASSES = np.stack([_UPPER, _LETTER, _DIGIT, _MARK, _SYMBOL]).astype(np.float64)


def _share(part: float, whole: float) -> float:
    """Variance-stabilised share, drawn towards 0 in short texts, where a share says little."""
    return math.asin(math.sqrt(min(1.0, part / (whole + DAMPING))))


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one whole UTF-8 text; all defined for an empty one."""
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    upper, letters, digits, marks, symbols = (_CLASSES @ counts).tolist()
    visible = float(len(raw) - counts[_SPACE].sum())
    words = text.split()
    n = len(words)
    sizes = np.fromiter(map(len, words), np.float64, n)
    common = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = np.flatnonzero(_SPACE[raw[1:]] & ~_SPACE[raw[:-1]]) if len(raw) > 1 else np.empty(0, np.int64)
    tail = np.concatenate([raw[ends], raw[-1:]]) if len(raw) else raw
    share = counts[counts > 0] / max(1, len(raw))
    grams = Counter(zip(words, words[1:], words[2:]))
    return [
        math.log1p(len(raw)), math.log1p(n), math.log1p(float(sizes.mean()) if n else 0.0), math.log1p(float(sizes.std()) if n else 0.0),
        _share(letters, visible), _share(upper, letters), _share(digits, visible), _share(marks, visible), _share(symbols, visible),
        _share(float(_SYMBOL[tail].sum()), len(tail)), _share(float((tail == 33).sum()), len(tail)),
        _share(len(common), n) * math.log(n + 3), _share(max(common.values(), default=0), n), _share(sum(map(eq, words, words[1:])), max(n - 1, 0)),
        _share(len(lines) - len(set(lines)), len(lines)), float(-(share * np.log2(share)).sum()) if len(raw) else 0.0,
        _share(sum(grams.values()) - len(grams), max(n - 2, 0)),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, x array<double>) per row, in the order of FEATURES; a null text counts as empty."""

    def make():
        return lambda texts: [pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))]

    return per_text(docs, text_col, [id_col], "x array<double>", make)


def fit(rows: DataFrame, x_col: str = "x", label_col: str = "label") -> dict:
    """Discriminant of rows with label 0 or 1 (others are left out).

    The moments are summed in tasks, then per (class, entry). A class without rows gives a constant score of 0.5,
    or the other class's certainty.
    """
    d = len(FEATURES)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, d)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            for k, total in sums.items():
                own = x[y == k]
                total += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        size = 1 + d + d * d
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], size).astype(np.int32)), pa.array(np.tile(np.arange(size, dtype=np.int32), 2)),
             pa.array(np.concatenate([sums[0], sums[1]]))], names=["k", "at", "value"])

    known = rows.filter(F.col(label_col).isin(0, 1)).select(F.col(x_col).alias("x"), F.col(label_col).cast("int").alias("label"))
    total = known.mapInArrow(make, "k int, at int, value double").groupBy("k", "at").agg(F.sum("value").alias("value")).collect()
    moments = np.zeros((2, 1 + d + d * d))
    for row in total:
        moments[row["k"], row["at"]] = row["value"]
    return discriminant(moments, d)


def discriminant(moments: np.ndarray, d: int, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> dict:
    counts = moments[:, 0]
    if counts.min() < 1:
        return {"constant": 0.5 if counts.max() < 1 else float(counts[1] > 0)}
    means = moments[:, 1 : 1 + d] / counts[:, None]
    cov = [moments[k, 1 + d :].reshape(d, d) / counts[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (counts[0] * cov[0] + counts[1] * cov[1]) / counts.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    factors, logdets = [], []
    for k in (0, 1):
        s = ((1 - to_pooled) * cov[k] + to_pooled * pooled) / np.outer(scale, scale)
        s = (1 - to_identity) * s + to_identity * max(np.trace(s) / d, 1e-6) * np.eye(d)
        low = np.linalg.cholesky(s)
        logdets.append(2 * float(np.log(np.diag(low)).sum()))
        factors.append(np.linalg.inv(low))
    return {"scale": scale, "means": means, "factors": factors, "logdets": logdets, "priors": np.log(counts / counts.sum()).tolist()}


def score(stats: DataFrame, model: dict, id_col: str = "doc_id", temperature: float = TEMPERATURE) -> DataFrame:
    """(id_col, score) per row of statistics: the probability of label 1 from the Mahalanobis log-density difference."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if "constant" in model:
                out = np.full(batch.num_rows, model["constant"])
            else:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                logs = [
                    -0.5 * (((x - m) / model["scale"] @ w.T) ** 2).sum(axis=1) - 0.5 * ld + p
                    for m, w, ld, p in zip(model["means"], model["factors"], model["logdets"], model["priors"])
                ]
                out = 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / temperature, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out)], names=["id", "score"])

        return step

    kind = stats.schema[id_col].dataType.simpleString()
    return per_row(stats.select(F.col(id_col).alias("id"), "x"), f"id {kind}, score double", make).toDF(id_col, "score")
