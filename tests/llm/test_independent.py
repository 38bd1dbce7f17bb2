"""Quality and language queries against versions written anew in plain Python over the whole tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewater.llm import langid, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


# Quality


def described(text):
    """The 17 statistics, character class by character class, from their names."""
    raw = (text or "").encode()
    share = lambda part, whole: math.asin(math.sqrt(min(1.0, part / (whole + 12.0))))
    white = b" \t\n\v\f\r"
    letter = lambda b: chr(b) in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" or b >= 192
    mark = lambda b: b in b".,;:!?'\"()-"
    symbol = lambda b: 32 < b < 127 and not letter(b) and not 48 <= b <= 57 and not mark(b)
    count = lambda test: sum(1 for b in raw if test(b))
    visible = count(lambda b: b not in white)
    words = raw.split()
    sizes = [len(w) for w in words]
    mean = sum(sizes) / len(sizes) if sizes else 0.0
    spread = math.sqrt(sum((s - mean) ** 2 for s in sizes) / len(sizes)) if sizes else 0.0
    # Bytes before white space, and the last byte of the text
    ends = [a for a, b in zip(raw, raw[1:]) if a not in white and b in white] + list(raw[-1:])
    lines = [x for x in raw.split(b"\n") if x.strip()]
    frequency, grams = Counter(words), Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    entropy = -sum(n / len(raw) * math.log2(n / len(raw)) for n in Counter(raw).values())
    return [
        math.log(1 + len(raw)), math.log(1 + len(words)), math.log(1 + mean), math.log(1 + spread),
        share(count(letter), visible), share(count(lambda b: 65 <= b <= 90), count(letter)), share(count(lambda b: 48 <= b <= 57), visible),
        share(count(mark), visible), share(count(symbol), visible), share(sum(map(symbol, ends)), len(ends)), share(ends.count(33), len(ends)),
        share(len(frequency), len(words)) * math.log(len(words) + 3), share(max(frequency.values(), default=0), len(words)),
        share(sum(a == b for a, b in zip(words, words[1:])), max(0, len(words) - 1)), share(len(lines) - len(set(lines)), len(lines)),
        entropy, share(sum(grams.values()) - len(grams), max(0, len(words) - 2)),
    ]


def test_quality_query_against_plain_densities(spark, documents):
    """Shrunk class covariances and their Gaussian densities by determinant and inverse, without moments or factors."""
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()]
    x = {doc: np.array(described(text)) for doc, text, _ in documents}
    assert len(next(iter(x.values()))) == len(quality.FEATURES)
    taught = [(x[doc], label) for doc, label in labels if doc in x and label in (0, 1) and fold(doc, 5)]
    rows = [np.array([v for v, label in taught if label == k]) for k in (0, 1)]
    cov = [np.cov(r.T, bias=True) for r in rows]
    pooled = sum(len(r) * c for r, c in zip(rows, cov)) / len(taught)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    shrunk = []
    for c in cov:
        s = (0.8 * c + 0.2 * pooled) / np.outer(scale, scale)
        shrunk.append(0.95 * s + 0.05 * max(np.trace(s) / len(s), 1e-6) * np.eye(len(s)))

    def density(v, k):
        z = (v - rows[k].mean(axis=0)) / scale
        return -0.5 * z @ np.linalg.inv(shrunk[k]) @ z - 0.5 * np.linalg.slogdet(shrunk[k])[1] + math.log(len(rows[k]) / len(taught))

    got = {r["doc_id"]: r for r in queries.QUERIES["op1_quality"](spark, SF).collect()}
    assert got.keys() == x.keys()
    for doc, v in x.items():
        want = 1 / (1 + math.exp(-max(-700, min(700, (density(v, 1) - density(v, 0)) / 4))))
        assert got[doc]["score"] == pytest.approx(want, abs=1e-6) and got[doc]["held_out"] == (fold(doc, 5) == 0)
        assert got[doc]["predicted"] == (want >= 0.3) or abs(want - 0.3) < 1e-6


# Language


def grams_of(text):
    """Buckets of the letters with their neighbours, what is no letter being 0."""
    points = [ord(c) if c.isalpha() else 0 for c in (text or "").lower()]
    out = []
    for before, here, after in zip([0, *points], points, [*points[1:], 0]):
        if here:
            h = (before * 0x9E3779B1 % 2**32) ^ (here * 0x85EBCA77 % 2**32) ^ (after * 0xC2B2AE3D % 2**32)
            h = (h ^ h >> 15) * 0x27D4EB2F % 2**32
            out.append(h >> 16)
    return Counter(out)


def mixture(likelihoods, counts):
    """Expectation-maximisation for proportions, gram by gram."""
    k, total = len(next(iter(likelihoods.values()))), sum(counts.values())
    share = [1 / k] * k
    for _ in range(60):
        taken = [0.0] * k
        for gram, n in counts.items():
            parts = [s * p for s, p in zip(share, likelihoods[gram])]
            whole = sum(parts)
            taken = [t + n * part / whole for t, part in zip(taken, parts)]
        new = [t / total for t in taken]
        done = max(abs(a - b) for a, b in zip(new, share)) < 1e-4
        share = new
        if done:
            break
    return share, sum(n * math.log(sum(s * p for s, p in zip(share, likelihoods[gram]))) for gram, n in counts.items())


def test_language_query_against_a_plain_mixture(spark, documents):
    counts = defaultdict(Counter)
    for doc, text, lang in documents:
        if lang is not None and fold(doc, 4) != 2:
            counts[lang].update(grams_of(text))
    names = sorted(counts)
    totals = {lang: sum(c.values()) + 0.2 * 65536 for lang, c in counts.items()}
    likelihood = lambda gram: [float(np.float32((counts[lang][gram] + 0.2) / totals[lang])) for lang in names]
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_langid"](spark, SF).collect()}
    assert len(got) == len(documents)
    for doc, text, _ in documents:
        grams = grams_of(text)
        if not grams:
            assert (got[doc]["lang_pred"], got[doc]["score"]) == ("und", 0.0)
            continue
        p = {g: likelihood(g) for g in grams}
        share, _ = mixture({g: [*v, 1 / 65536] for g, v in p.items()}, grams)
        order = sorted(range(len(names)), key=lambda i: -share[i])
        total, best, chosen = sum(grams.values()), -math.inf, None
        for k in range(1, len(order) + 1):
            if k > 1 and share[order[k - 1]] * total < 1:
                break
            own, value = mixture({g: [v[i] for i in order[:k]] for g, v in p.items()}, grams) if k > 1 else ([1.0], sum(n * math.log(p[g][order[0]]) for g, n in grams.items()))
            value -= 2 * math.log(total + 1) * (k - 1)
            if value > best:
                best, chosen = value, (own, order[:k])
        pick = chosen[1][max(range(len(chosen[0])), key=lambda i: chosen[0][i])]
        assert got[doc]["lang_pred"] == names[pick] and got[doc]["score"] == pytest.approx(share[pick], abs=1e-3)
        assert set(got[doc]["languages"]) == {names[i] for i in chosen[1]}


def test_languages_of_a_stage_are_judged_alone():
    """What infer returns for a text does not depend on its neighbours: the model is the only input."""
    table = np.full((langid.BUCKETS, 2), 1 / langid.BUCKETS, np.float32)
    table[:100, 0], table[100:200, 1] = 0.005, 0.005
    best, share, chosen = langid.infer(np.arange(100), table, 2.0)
    assert best == 0 and share[0] > 0.9 and chosen == [0]
    assert re.match("und", langid.UNDETERMINED)
