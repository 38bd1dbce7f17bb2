"""Language identification as mixture inference: every document is a mixture of language n-gram distributions.

Training counts hashed letter trigrams per language, summed in tasks first. For a document, expectation-maximisation gives
the proportion of each language and of a background, all trigrams alike, which takes what no language explains; among the nested
sets of its most likely languages the one with the best penalised likelihood is selected, and the language with the largest
proportion in it is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import per_text, slices, utf8

#: Trigrams are hashed to this many buckets, so a model holds languages x BUCKETS numbers whatever the corpus
BUCKETS = 1 << 16
SMOOTHING = 0.2
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: bytes, letters: np.ndarray) -> np.ndarray:
    """Buckets of the trigrams around every letter of the whole text; other characters count as one word boundary."""
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    if not len(points):
        return points
    x = np.zeros(len(points) + 2, np.uint32)
    np.multiply(points, letters[points], out=x[1:-1])
    at = np.flatnonzero(x)
    h = x[at - 1] * np.uint32(0x9E3779B1) ^ x[at] * np.uint32(0x85EBCA77) ^ x[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    return h >> np.uint32(16)


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Smoothed log-free trigram distributions of every language in ``rows``; null languages and texts teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, totals = _letters(), {}
        for batch in batches:
            for part in slices(batch, "text"):
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    if lang not in totals:
                        totals[lang] = np.zeros(BUCKETS, np.int64)
                    totals[lang] += np.bincount(trigrams(text, letters), minlength=BUCKETS)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "at", "n"])

    source = rows.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), utf8(text_col).alias("text"))
    counted = source.mapInArrow(count, "lang string, at int, n bigint").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    packed = counted.groupBy("lang").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
    names, table = [], []
    # At most BUCKETS numbers a language
    for row in sorted(packed.collect(), key=lambda r: r["lang"]):
        dense = np.full(BUCKETS, SMOOTHING)
        dense[row["at"]] += row["n"]
        names.append(row["lang"])
        table.append((dense / dense.sum()).astype(np.float32))
    return {"languages": names, "table": np.stack(table, axis=1) if table else np.zeros((BUCKETS, 0), np.float32)}


def _em(p: np.ndarray, counts: np.ndarray, rounds: int = 60, close: float = 1e-4) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of the mixture with component likelihoods ``p`` (n-grams x languages)."""
    k = p.shape[1]
    share, n = np.full(k, 1 / k), counts.sum()
    for _ in range(rounds):
        mixed = p @ share
        new = share * ((counts / mixed) @ p) / n
        done = np.abs(new - share).max() < close
        share = new
        if done:
            break
    return share, float(counts @ np.log(p @ share))


def infer(buckets: np.ndarray, table: np.ndarray, penalty: float) -> tuple[int, np.ndarray, list[int]]:
    """Best language, proportions of the languages under the full mixture (the background has the rest), selected set."""
    at, counts = np.unique(buckets, return_counts=True)
    p, counts = table[at].astype(np.float64), counts.astype(np.float64)
    share = _em(np.column_stack([p, np.full(len(p), 1 / BUCKETS)]), counts)[0][:-1]
    order = np.argsort(-share, kind="stable")
    best, chosen, chosen_share = -np.inf, order[:1], np.ones(1)
    cost = penalty * np.log(counts.sum() + 1)
    for k in range(1, len(order) + 1):
        part = order[:k]
        if k == 1:
            own, value = np.ones(1), float(counts @ np.log(p[:, part[0]]))
        elif share[order[k - 1]] * counts.sum() < 1:
            break
        else:
            own, value = _em(p[:, part], counts)
        if value - cost * (k - 1) > best:
            best, chosen, chosen_share = value - cost * (k - 1), part, own
    return int(chosen[np.argmax(chosen_share)]), share, [int(x) for x in chosen]


def identify(
    docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", penalty: float = 2.0, keep: list[str] | None = None,
    with_explained: bool = False,
) -> DataFrame:
    """(id_col or the columns ``keep``, lang_pred, score, languages) per row, from the whole text alone; ``with_explained`` adds explained.

    ``score`` is the predicted language's proportion in the full mixture, ``languages`` the selected set, ``explained`` the
    proportion of all languages, which is small for languages and scripts that were not learned. A null text, one
    without a letter, and any text under a model without languages are ``und`` with score 0 and an empty set.
    """
    names, table = model["languages"], model["table"]

    def make():
        letters = _letters()

        def compute(texts: list[bytes]) -> list[pa.Array]:
            best, score, found, explained = [], [], [], []
            for text in texts:
                grams = trigrams(text, letters)
                if not len(grams) or not names:
                    best.append(UNDETERMINED), score.append(0.0), found.append([]), explained.append(0.0)
                    continue
                k, share, chosen = infer(grams, table, penalty)
                best.append(names[k]), score.append(min(1.0, float(share[k]))), found.append([names[x] for x in chosen])
                explained.append(min(1.0, float(share.sum())))
            made = [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(found, pa.list_(pa.string()))]
            return made + [pa.array(explained, pa.float64())] * with_explained

        return compute

    return per_text(docs, text_col, keep or [id_col], "lang_pred string, score double, languages array<string>" + ", explained double" * with_explained, make)
