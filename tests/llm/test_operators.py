"""Training-data operators against brute force, public libraries, exact round trips and held-out labels."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from compare import check, connect
from pyspark.sql import functions as F

from tidewater.llm import bpe, chat, components, decontaminate, langid, minhash, pii, quality, queries, topk, urlfilter, warc
from tidewater.llm.shared import shared_folder

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id BIGINT, text STRING, lang STRING, score STRING, id STRING"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").toPandas()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, extra columns named like those the operators add."""
    rows = [
        (1, None, "en", "x", "y"), (2, "", "en", None, None), (3, " \t\n", None, "x", "y"), (4, "the and of " * 20_000, "en", "x", "y"),
        (5, "same text in two rows", "en", "x", "y"), (5, "same text in two rows", "en", "x", "y"), (None, "no id here", "en", "x", "y"),
        (7, "12345 !!! 678", "en", "x", "y"), (8, "la une des les et", "fr", "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_against_sql(spark, key):
    problem, rows, _, _ = check(spark, connect(SF), key, queries.QUERIES[key], queries.ORACLES[key], SF)
    assert not problem and rows


# Quality


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.QUERIES["op1_quality"](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    both = out.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (held.predicted == held.quality).mean() > 0.95 and out.score.between(0, 1).all()
    assert held[held.quality == 1].score.mean() > held[held.quality == 0].score.mean() + 0.5


def test_quality_odd_rows(spark, odd):
    stats = quality.document_statistics(odd)
    assert stats.count() == odd.count()
    assert all(np.isfinite(r.x).all() and len(r.x) == len(quality.FEATURES) for r in stats.collect())
    assert quality.fit(stats.withColumn("label", F.lit(1)))["constant"] == 1.0
    assert quality.fit(stats.withColumn("label", F.lit(None).cast("int")))["constant"] == 0.5
    assert quality.score(quality.document_statistics(empty(spark)), {"constant": 0.5}).count() == 0


def test_discriminant_is_the_density_difference():
    rng = np.random.default_rng(1)
    x = [rng.normal(k, 1 + k, (500, 3)) for k in (0, 1)]
    moments = np.stack([np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).ravel()]) for v in x])
    model = quality.discriminant(moments, 3, 0.0, 0.0)
    point = np.array([0.3, -0.2, 1.0])
    for k in (0, 1):
        mean, cov = x[k].mean(axis=0), np.cov(x[k].T, bias=True)
        want = -0.5 * (point - mean) @ np.linalg.inv(cov) @ (point - mean) - 0.5 * np.log(np.linalg.det(cov))
        got = -0.5 * ((((point - model["means"][k]) / model["scale"]) @ model["factors"][k].T) ** 2).sum() - 0.5 * model["logdets"][k]
        assert abs((got - np.log(model["scale"]).sum()) - want) < 1e-8


# Top-k


def test_topk_ties_nulls_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1),
        (7, [-1.0, 0.0], 1), (7, [-1.0, 0.0], 1), (8, [1.0], 1), (None, [9.0, 9.0], 1), (50, [0.0, 0.0], 1), (9, [], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, rank INT")
    out = topk.top_k(df, "id % 50 = 0", k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in out] == [
        (0, 1, 1, 81920), (0, 2, 2, 81920), (0, 3, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0), (50, 3, 2, 0)]
    assert topk.top_k(df.limit(0), "id % 50 = 0").count() == 0


def test_threshold_search_equals_scan_and_stops_early():
    rng = np.random.default_rng(5)
    rows = rng.integers(-40, 40, (600, 6)).astype(np.float64)
    rows[:, 0] *= np.linspace(0, 20, 600)
    order, ids = np.argsort(rows, axis=0, kind="stable").T.copy(), rng.permutation(600)
    for own in range(20):
        query = rows[own] * (rng.random(6) > 0.3)
        scores = rows @ query
        want = sorted(((int(s), int(i)) for s, i in zip(scores, ids) if i != ids[own]), key=lambda x: (-x[0], x[1]))[:5]
        assert topk.threshold_search(rows, ids, order, query, int(ids[own]), 5) == want
    big = np.array([[1 << 40, 3], [1 << 40, 4]], dtype=object)
    best = topk.threshold_search(big, np.array([1, 2]), np.array([[0, 1], [0, 1]]), np.array([1 << 40, 1], dtype=object), 9, 2)
    assert best == [((1 << 80) + 4, 2), ((1 << 80) + 3, 1)]


# Chat


TURNS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, window STRING"


def test_chat_round_trip(spark):
    said = [
        (1, 0, "system", "be kind", ""), *[(1, i, "assistant" if i % 2 else "user", f"{i} " * (i % 40), "") for i in range(1, 300)],
        (2, 0, "user", "\\### Assistant: </turn> ok", ""), (2, 1, "assistant", "####\\\\# </turn></turn>\n### user: x</turn>\n", ""),
        (3, None, None, None, ""), (3, None, "a: \\b", "x\\", ""), (3, 2, "assistant", "", ""), (3, 2, "assistant", "", ""),
        (4, 0, "system", "alone", ""), (None, 1, "assistant", "é🙂" * 2000, ""), (5, 0, "user", "w " * 5000, ""), (5, 1, "system", "late", ""),
    ]
    df = spark.createDataFrame(said, TURNS)
    out = chat.format_windows(df, span=64, history=24).select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for conv in {r[0] for r in said}:
        rows = sorted((r for r in said if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        own = sorted((r for r in out if r.conv_id == conv), key=lambda r: r.window)
        new = [(t.role, t.text) for w in own for t in w.turns[w.n_repeated :]]
        assert new == [(r[2] or "", r[3] or "") for r in rows]
        assert [x for w in own for x in w.loss] == [r[3] for r in rows if r[2] == "assistant"]
        for w in own:
            assert len(w.turns) == w.n_turns
            costs = [len(re.findall(r"[^\x09-\x0D\x20]+", t.text)) + 4 for t in w.turns]
            system = rows[0][2] == "system"
            fresh = costs[w.n_repeated :][(1 if system and w.window == 0 else 0) :]
            assert sum(fresh) <= 64 or len(fresh) == 1
            assert sum(costs[(1 if system and w.window else 0) : w.n_repeated]) <= 24
            if system and w.window:
                assert w.turns[0].text == rows[0][3] and w.n_repeated >= 1
    assert chat.format_windows(df.limit(0)).count() == 0


# BPE


def encoder():
    ranks = bpe.load_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_the_library(spark, documents):
    out = queries.QUERIES["op4_bpe"](spark, SF).toPandas().set_index("doc_id")
    enc = encoder()
    for row in documents.itertuples():
        ids = enc.encode_ordinary(row.text)
        got = out.loc[row.doc_id]
        assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(row.text))


def test_bpe_pieces():
    ranks, enc = bpe.load_ranks(RANKS), encoder()
    random.seed(2)
    texts = ["".join(random.choice("abthe ions'\n\t\x0b\x1c\x85　ßé0123日本🙂́") for _ in range(n)) for n in [0, 1, 2, 3, 30] * 40 + [2000]]
    pieces = bpe.Pieces(ranks)
    split = bpe.regex.compile(public_tokenizers.PATTERN).findall
    ids, counts = pieces.encode([split(t) for t in texts])
    ends = np.cumsum(counts)
    assert [ids[b - c : b].tolist() for b, c in zip(ends, counts)] == [enc.encode_ordinary(t) for t in texts]
    long = "".join(random.choice("etaoin") for _ in range(5000))
    assert bpe.merge(long.encode(), ranks) == enc.encode_ordinary(long)
    assert bpe.merge(b"", ranks) == []


def test_bpe_odd_rows(spark, odd):
    coded = bpe.encode(odd, RANKS, public_tokenizers.PATTERN, keep=["id", "text"])
    rows = coded.select("doc_id", "ids", "text", bpe.decode(F.col("ids"), RANKS).alias("back")).collect()
    assert len(rows) == odd.count() and all(bytes(r.back) == (r.text or "").encode() for r in rows)
    assert [len(r.ids) for r in rows if r.doc_id in (1, 2)] == [0, 0]
    bad = spark.createDataFrame([(None,), ([999_999],), ([],)], "ids ARRAY<INT>").select(bpe.decode(F.col("ids"), RANKS).alias("b")).collect()
    assert [r.b if r.b is None else bytes(r.b) for r in bad] == [None, None, b""]
    assert bpe.encode(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


# Near duplicates


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def brute_components(rows, width, percent):
    sets, parent = [(i, shingles(t, width)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(x), find(i)) for i, x in sets}


def test_near_duplicates_against_all_pairs(spark, documents):
    want = brute_components([(int(r.doc_id), r.text) for r in documents.itertuples()], 3, 85)
    out = queries.QUERIES["op5_minhash"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    """Copies of a short text with random edits, where many pairs lie on either side of the threshold."""
    monkeypatch.setattr(minhash, "OUTSIDERS", 8)
    monkeypatch.setattr(minhash, "MEMBERS", 16)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 10)
    random.seed(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(250):
        words = list(base)
        for _ in range(random.choice([0, 1, 1, 2])):
            words[random.randrange(60)] = f"x{random.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    out = minhash.near_duplicates(df, width=3, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, 3, 85)


def test_near_duplicates_odd_rows(spark, odd):
    out = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()}
    assert (1, 0, 1, True) in out and (2, 0, 2, True) in out and (3, 0, 3, True) in out
    assert (5, 1, 5, True) in out and (None, 1, None, True) in out and (4, 3, 4, True) in out
    assert minhash.near_duplicates(odd).count() == odd.count()
    assert minhash.near_duplicates(empty(spark)).count() == 0
    shared = spark.createDataFrame([(9, "a b c d e f"), (3, "u v w x y z"), (9, "u v w x y z"), (4, "a b c d e f")], "doc_id BIGINT, text STRING")
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(shared).collect()} == {(9, 3), (3, 3), (4, 3)}


def test_components(spark):
    random.seed(8)
    links = [(random.randrange(400), random.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (5, 5)]
    out = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a BIGINT, b BIGINT"), "a", "b").collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    assert out == {x: find(x) for x in list(parent)}


# Leaks


def test_leaks_against_containment(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    norm = lambda t: " " + " ".join(w for w in re.split(r"[\W_]+", t.lower()) if w) + " "
    texts = [(int(r.doc_id), norm(r.text)) for r in documents.itertuples()]
    want = {(d, r.item_id) for r in items for d, t in texts if norm(r.text) in t}
    out = queries.QUERIES["op6_decontaminate"](spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in out} == want and all(r.exact for r in out)


def test_leaks_with_other_values(spark, monkeypatch):
    items = spark.createDataFrame([
        (1, "A train leaves Boston at 60 km per hour and reaches Denver after 5 hours. How far is Denver?"), (2, "short item"), (3, "123 456 789"),
        (4, None), (5, ""), (6, "Maria has 12 apples and gives 3 apples to Paul before lunch today"), (None, "nobody asked for this question at all today"),
    ], "item_id BIGINT, text STRING")
    train = "x. A train leaves {0} at 90 km per hour and reaches {1} after 7 hours. How far is {2}? so"
    rows = [
        (1, train.format("Paris", "Rome", "Rome"), "q"), (2, train.format("Paris", "Rome", "Oslo"), "q"), (3, "a very short item indeed", "q"),
        (4, "1 2 3 123 456 789", "q"), (5, None, "q"), (6, "", "q"), (7, "a train leaves boston at 60 km per hour and reaches denver after 5 hours how far is denver", "q"),
        (8, "Anna has 40 apples and gives 8 apples to Tom before lunch today", "q"), (9, "a train leaves at noon", "q"), (None, "short item", "q"),
        (3, "a very short item indeed", "q"),
    ]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, item STRING")
    want = {(1, 1, False), (3, 2, True), (7, 1, True), (8, 6, False)}
    assert {(r.doc_id, r.item_id, r.exact) for r in decontaminate.find_leaks(df, items).collect()} == want
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_IDS", 0)
    assert {(r.doc_id, r.item_id, r.exact) for r in decontaminate.find_leaks(df, items).collect()} == want
    assert decontaminate.find_leaks(df, items.limit(0)).count() == 0 and decontaminate.find_leaks(df.limit(0), items).count() == 0


def leaks(spark, items, texts):
    """(document, item) positions of the leaks found."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    asked = spark.createDataFrame(list(enumerate(items)), "item_id BIGINT, text STRING")
    return {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, asked).collect()}


def test_leaks_with_words_put_in_and_longer_names(spark):
    rng = np.random.default_rng(5)
    long = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    train = "x. A train leaves {0} at 90 km per hour and reaches {1} after 7 hours. How far is {1}? so"
    texts = [
        " ".join(long[:150] + ["page"] + long[150:]), " ".join(long[:100] + long[101:200] + ["27", "28"] + long[200:]), " ".join(long[:100]),
        train.format("Boston", "Salt Lake City"), train.format("New York", "Rome"), " ".join(reversed(long)), " ".join(long[:150] + ["z"] * 5000 + long[150:]),
    ]
    out = leaks(spark, [" ".join(long), "A train leaves Boston at 60 km per hour and reaches Denver after 5 hours. How far is Denver?"], texts)
    assert set(out) == {(0, 0), (1, 0), (3, 1), (4, 1)} and out[0, 0].matched == 286 and not out[3, 1].exact
    other = leaks(spark, ["Salt Lake City is the largest town between Reno and Grand Junction today"], [
        "we know that Salt Lake City is the largest town between Reno and Grand Junction today", "salt lake city is the largest town between reno and grand junction today"])
    assert set(other) == {(0, 0), (1, 0)}


def test_leaks_of_numbers_and_names(spark):
    table = " ".join(f"{k * k + 7} {k * 31}" for k in range(20))
    items = ["What is 12 + 7?", "Is Paris in France?", "Compute the total of " + table, "Dates: " + ", ".join(f"May {k}, 19{k}" for k in range(10, 25))]
    texts = ["Now: What is 12 + 7? Nineteen.", "He asked. Is Paris in France? Yes.", "so " + items[2], "so " + items[3], "What is 13 + 7? Is Rome in Italy?", "Compute the total of " + " ".join(str(k) for k in range(50))]
    out = leaks(spark, items, texts)
    assert set(out) == {(k, k) for k in range(4)} and all(r.exact and r.coverage == 1 for r in out.values())


def test_leaks_with_an_altered_value_or_another_end(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(200)]
    put = lambda at: " ".join(at.get(i, w) for i, w in enumerate(words))
    item, other = put({20: "17", 120: "17", 150: "Denver", 190: "40"}), put({20: "17", 40: "17", 60: "17", 120: "17"})
    texts = [
        put({20: "17", 120: "18", 150: "Denver", 190: "40"}), " ".join(item.split()[:130] + [w[::-1] for w in words[130:150]] + ["Oslo"] + ["so"] * 39 + ["50"]),
        put({20: "5", 40: "5", 60: "5", 120: "6"}), put({20: "5", 40: "6", 60: "7", 120: "8"}),
    ]
    out = leaks(spark, [item], texts[:2])
    assert set(out) == {(0, 0), (1, 0)} and not out[0, 0].exact and out[1, 0].exact and out[0, 0].matched == 193 - 8
    out = leaks(spark, [other], texts[2:])
    assert {k: (r.matched, r.exact) for k, r in out.items()} == {(0, 0): (193 - 8, False), (1, 0): (193 - 32, False)}
    swapped = leaks(spark, ["we add 4 and 5 and 4 and 5 to get a sum"], ["we add 7 and 8 and 9 and 6 to get a sum"])
    assert not swapped


# Language


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.QUERIES["op7_langid"](spark, sf).toPandas()
    both = out.merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (held.lang == held.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()


def test_language_training_counts(spark, documents):
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    letters = langid._letters()
    for k, lang in enumerate(model["languages"]):
        counts = Counter()
        for text in documents.text[documents.lang == lang]:
            counts.update(langid.trigrams(text.encode(), letters).tolist())
        dense = np.full(langid.BUCKETS, langid.SMOOTHING)
        for at, n in counts.items():
            dense[at] += n
        assert np.allclose(model["table"][:, k], dense / dense.sum(), rtol=1e-5)


def test_language_mixture(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    text = {r.lang: r.text for r in docs.filter("length(text) > 600").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    mixed = spark.createDataFrame([(1, text["en"][:500] + " " + text["fr"][:250])], "doc_id BIGINT, text STRING")
    found = langid.identify(mixed, model).first()
    assert found.lang_pred == "en" and set(found.languages) == {"en", "fr"} and 0.5 < found.score < 0.85
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3, 7)) and rows[8].lang_pred == "fr"
    kept = langid.identify(odd, model, keep=odd.columns[:3])
    assert kept.count() == odd.count() and kept.columns == ["doc_id", "text", "lang", "lang_pred", "score", "languages"]
    assert langid.train(empty(spark))["languages"] == [] and langid.identify(odd, langid.train(empty(spark))).filter("lang_pred <> 'und'").count() == 0


# URL filters


def test_url_filter_as_of(spark):
    entries = spark.createDataFrame([
        ("example.com", "block", "2024-01-10"), ("example.com", "allow", "2024-02-01"), ("Example.com", "block", "2024-02-01"), ("example.com", "allow", "2024-03-01"),
        ("good.example.com", "allow", "2024-01-01"), ("example.com/news", "allow", "2024-01-15"), ("x.org", "block", None), (None, "block", "2024-01-01"), ("y.org", "other", "2024-01-01"),
    ], "pattern STRING, action STRING, listed_on STRING").withColumn("listed_on", F.to_date("listed_on"))
    captures = [
        (1, "http://www.example.com/a", "2024-01-09", False), (2, "http://www.example.com/a", "2024-01-10", True), (3, "https://u:p@EXAMPLE.com.:80/", "2024-02-10", True),
        (4, "http://example.com/", "2024-03-01", False), (5, "http://a.good.example.com/x", "2024-01-20", False), (6, "http://example.com/news/1?q", "2024-01-20", False),
        (7, "http://example.com/newsroom", "2024-01-20", True), (8, None, "2024-01-20", False), (9, "no url", "2024-01-20", False), (10, "http://example.com/", None, False),
        (11, "http://x.org/", "2024-05-01", False), (2, "http://www.example.com/a", "2024-01-10", True), (12, "http://notexample.com/", "2024-01-20", False),
        (13, "http://y.org/" + "p/" * 5000, "2024-01-20", False),
    ]
    df = spark.createDataFrame(captures, "page_id BIGINT, url STRING, day STRING, pattern BOOLEAN").withColumn("fetched_on", F.to_date("day"))
    out = urlfilter.filter_urls(df, entries)
    assert sorted((r.page_id, r.blocked) for r in out.collect()) == sorted((c[0], c[3]) for c in captures)
    assert urlfilter.filter_urls(df, entries.limit(0)).filter("blocked").count() == 0 and urlfilter.filter_urls(df.limit(0), entries).count() == 0


def test_url_filter_of_long_hosts_deep_paths_and_capitals(spark):
    host, path = ".".join(f"l{i}" for i in range(20)) + ".com", "/".join(f"s{i}" for i in range(12))
    entries = spark.createDataFrame(
        [(p, "block", "2024-01-01") for p in (host, f"a.org/{path}", "B.org/News", "c.org/news")], "pattern STRING, action STRING, listed_on STRING").withColumn("listed_on", F.to_date("listed_on"))
    urls = {
        f"http://{host}/": True, f"http://www.{host}/x": True, f"http://{host.split('.', 1)[1]}/": False, f"http://a.org/{path}/more": True, f"http://a.org/{path[:-1]}": False,
        "http://b.org/News/1": True, "http://b.org/news/1": False, "http://c.org/news": True, "http://c.org/News": False,
    }
    df = spark.createDataFrame([(u,) for u in urls], "url STRING").withColumn("fetched_on", F.to_date(F.lit("2024-02-01")))
    assert {r.url: r.blocked for r in urlfilter.filter_urls(df, entries).collect()} == urls


# WARC


def pages(spark):
    rows = [(3, "http://a b/\n", "same"), (1, None, "same"), (2, "http://x/é", None), (4, "u", ""), (None, "n", "same"), (5, "v", "x" * 300_000), (6, "v", "one\r\n\r\n")]
    return spark.createDataFrame(rows + [(100 + i, "http://h/", f"<html>{i} " + "page body " * 30) for i in range(200)], "page_id BIGINT, url STRING, html STRING")


def test_archives_round_trip(spark):
    df = pages(spark)
    archives = warc.write_archives(df, shared_folder(spark, "test"), "page_id", F.col("html"), F.col("url"))
    back = warc.read_archives(archives).withColumn("page_id", warc.row_id(F.col("record_id")).cast("bigint")).collect()
    want = {r.page_id: (r.html or "").encode() for r in df.collect()}
    assert len(back) == len(want) == archives.agg(F.sum("records")).first()[0] and all(r.error is None for r in back)
    for r in back:
        payload = want[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type == "revisit") == (r.page_id in (3, None, 4)) and (r.record_type == "revisit" or bytes(r.payload) == payload)
    refers = {r.page_id: r.refers_to for r in back}
    assert (refers[3], refers[None], refers[4], refers[1]) == ("urn:row:1", "urn:row:1", "urn:row:2", None)
    few = warc.mark_revisits(df, "page_id", F.col("html"), min_bytes=5).filter("_refers_to is not null")
    assert few.count() == 0
    assert warc.read_archives(warc.write_archives(df.limit(0), shared_folder(spark, "test"), "page_id", F.col("html"), F.col("url"))).count() == 0


def test_archives_begin_with_the_dictionary_and_report_faults(spark, tmp_path):
    import io

    archives = warc.write_archives(pages(spark).coalesce(1), shared_folder(spark, "test"), "page_id", F.col("html"), F.col("url"))
    system, path = warc._at(archives.first().archive)
    raw = system.open_input_stream(path).read()
    assert raw[:4] == warc.DICTIONARY_MAGIC
    whole = list(warc.frames(io.BytesIO(raw), 100))
    assert all(f is None for _, f in whole)
    assert list(warc.frames(io.BytesIO(raw), 1 << 20)) == whole
    assert list(warc.frames(io.BytesIO(raw[:-3])))[-1] == (None, "truncated frame")
    size = 8 + int.from_bytes(raw[4:8], "little")
    assert list(warc.frames(io.BytesIO(raw[:size] + b"junk" + raw[size:]))) == [(None, "bad frame magic")]
    assert list(warc.frames(io.BytesIO(raw[: size + 30] + bytes([raw[size + 30] ^ 255]) + raw[size + 31 :])))[0][0] is None
    assert list(warc.frames(io.BytesIO(b""))) == [] and list(warc.frames(io.BytesIO(b"abc"))) == [(None, "truncated frame")]
    good = warc.record("response", "urn:row:1", None, "http://x/", "2024-01-01T00:00:00Z", b"body")
    assert "error" not in warc.parse(good) and warc.parse(good)["payload"] == b"body"
    assert warc.parse(good[:-1])["error"] == "length mismatch" and warc.parse(b"x")["error"] == "no WARC header"
    assert warc.parse(good.replace(b"body", b"bodx"))["error"] == "payload digest mismatch"
    assert warc.parse(good.replace(b"WARC-Date", b"WARC-Dat"))["error"] == "no warc-date"


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            sound = {
                "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if sound:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def test_personal_data_against_regular_expressions(spark, documents):
    out = queries.QUERIES["op10_pii"](spark, SF).toPandas().set_index("doc_id")
    for row in documents.itertuples():
        want = brute_spans(row.text)
        got = out.loc[row.doc_id]
        assert got.base_sha256 == sha(listed(want)) and {s for s in listed(want).split(",") if s} <= set(got.spans.split(","))
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [sum(s[3] == k for s in want) for k in PATTERNS]


def test_personal_data_odd_texts(spark):
    random.seed(3)
    texts = [
        None, "", "@@@a@b.c.d_x@y.z é🙂 1.2.3.4.5.6.7.8.9 +1 (555) 123-4567 4111 1111 1111 1111 \x01\x02 x@y.co", "0.1.7.7 1.2.3.256 01.02.003.0004 000000255.1.1.1",
        "9" * 3000 + " 4111111111111111", "a" * 3000 + "@x.y", "4111-1111 1111-1111 4242424242424242-", "a.b@" * 500, " 1.1.1.1" * 1500, "+1 4111111111111111",
    ] + ["".join(random.choice("ab1234567890.@+- ()é🙂_%") for _ in range(random.randint(1, 300))) for _ in range(800)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, spans STRING")
    found = pii.find_spans(df)
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    out = found.select("doc_id", pii.listed(base).alias("base"), pii.redact(F.coalesce("text", F.lit("")), base).alias("clean")).collect()
    for r in out:
        text = texts[r.doc_id] or ""
        spans = brute_spans(text)
        assert r.base == listed(spans)
        clean, at = "", 0
        for a, _, b, kind in spans:
            if a >= at:
                clean += text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        assert r.clean == clean + text[at:]
    long = spark.createDataFrame([(1, "9" * 500_000), (2, "+" + "1" * 500_000), (3, "a" * 500_000), (4, " 1.1.1.1" * 20_000)], "doc_id BIGINT, text STRING")
    assert [r[0] for r in pii.find_spans(long).orderBy("doc_id").select(F.size("spans")).collect()] == [0, 0, 0, 20_000]
    assert pii.find_spans(df.limit(0)).count() == 0


def test_personal_data_validators_and_context(spark):
    rows = [
        (1, "iban DE89 3704 0044 0532 0130 00 end", ["iban"]), (2, "iban DE88 3704 0044 0532 0130 00 end", []), (3, "GB82WEST12345698765432", ["iban"]),
        (4, "ssn 123-45-6789", ["ssn"]), (5, "order 123-45-6789", []),
    ]
    out = pii.find_spans(spark.createDataFrame(rows, "id BIGINT, text STRING, kinds ARRAY<STRING>"))
    for r in out.collect():
        assert [s.kind for s in r.spans if s.kind not in pii.BASE] == r.kinds
    a, b = (pii.find_spans(spark.createDataFrame([(t,)], "text STRING")).first().spans[0].score for t in ("mail me: a@b.cd", "sample version a@b.cd"))
    assert a > b


def redacted(text, spans):
    """Overlapping spans become one, named by the first."""
    out, at = "", 0
    for start, end, kind in spans:
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_redact_equals_a_plain_cut(spark):
    rng = random.Random(7)
    kind = "array<struct<start:int,rank:int,end:int,kind:string,value:string,score:double>>"
    rows = []
    for n in (0, 1, 2, 5, 40, 900):
        text = "".join(rng.choice("ab é€😀\n") for _ in range(n * 7 + 3))
        starts = sorted(rng.randrange(len(text)) for _ in range(n))
        spans = [(s, rng.choice(["email", "ip"]), min(len(text), s + rng.choice([1, 3, 30, 300]))) for s in starts]
        rows.append((text, [(s, 0, e, k, "", 1.0) for s, k, e in sorted(spans)], redacted(text, [(s, e, k) for s, k, e in sorted(spans)])))
    df = spark.createDataFrame(rows, f"text STRING, spans {kind}, want STRING")
    assert df.withColumn("got", pii.redact(F.col("text"), F.col("spans"))).filter("not got <=> want").isEmpty()
    text = "plain"
    assert spark.createDataFrame([(None, [], None), (text, None, text)], f"text STRING, spans {kind}, want STRING").withColumn(
        "got", pii.redact(F.col("text"), F.col("spans"))).filter("not got <=> want").isEmpty()


def test_redact_is_linear(spark):
    """A hundred thousand addresses in one text."""
    import time

    df = spark.range(1).select(F.repeat(F.lit("write to someone@example.org or "), 100_000).alias("text"))
    started = time.time()
    spans = pii.find_spans(df)
    done = spans.select(pii.redact(F.col("text"), F.col("spans")).alias("t"), F.size("spans").alias("n")).first()
    assert done["n"] == 100_000 and done["t"] == "write to [EMAIL] or " * 100_000 and time.time() - started < 120


def test_topk_keeps_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [2.0, 2.0]), (0, [3.0, 0.5]), (7, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    got = sorted(tuple(r) for r in topk.top_k(df, "id % 50 = 0", k=3).select("query_id", "rank", "vec_id", "score").collect())
    want = []
    for i, (query, q) in enumerate(rows):
        if query == 0:
            scored = sorted((-int(sum(256 * a * 256 * b for a, b in zip(q, v))), vec) for j, (vec, v) in enumerate(rows) if j != i)
            want += [(query, n + 1, vec, -score) for n, (score, vec) in enumerate(scored[:3])]
    assert got == sorted(want)


def test_threshold_walk_meets_nearly_all_rows_of_even_dimensions():
    """What the walk saves: with one strong dimension it stops before, with 64 even ones it has met almost all rows when it can stop."""
    rng = np.random.default_rng(2)
    met = {}
    for name, scale in (("strong", [400.0] + [1.0] * 7), ("even", [64.0] * 64)):
        rows = np.floor(rng.normal(0, 1, (2000, len(scale))) * scale)
        order = np.argsort(rows, axis=0, kind="stable").T.copy()
        seen = []
        query = rows[0]

        class Counted(np.ndarray):
            def __getitem__(self, at):
                if isinstance(at, np.ndarray) and at.ndim == 1:
                    seen.append(len(at))
                return super().__getitem__(at)

        got = topk.threshold_search(rows.view(Counted), np.arange(2000), order, query, 0, 5)
        scores = rows @ query
        want = sorted(((int(s), i) for i, s in enumerate(scores) if i), key=lambda x: (-x[0], x[1]))[:5]
        assert [(int(s), int(i)) for s, i in got] == want
        met[name] = sum(seen) / 2000
    assert met["strong"] < 0.8 and met["even"] > 0.9


ANNA = "Anna has 12 apples. Maria buys 3 apples from Anna. Anna then sells 4 pears to Maria. How many apples does Maria have?"


@pytest.mark.parametrize("filler", ["", "Some words come first. The Old Tower fell on Monday in Rome. ", "Then Then He said The Word. "])
def test_names_at_sentence_starts(spark, filler):
    """Other names and numbers, also where names begin sentences; a verbatim copy where the text has such words as names elsewhere."""
    other = ANNA.replace("Anna", "Tom").replace("Maria", "Eve").replace("12", "15").replace("3", "5").replace("4", "6")
    broken = other.replace("5 apples from Tom. Tom then", "5 apples from Tom. Eve then")
    docs = spark.createDataFrame([(1, filler + ANNA), (2, filler + other), (3, filler + other + " And more text follows here.")], "doc_id BIGINT, text STRING")
    item = spark.createDataFrame([(7, ANNA), (8, "What does The Old Tower of Rome cost on Monday for one visitor?")], "item_id BIGINT, text STRING")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, item).collect()}
    assert {(1, 7), (2, 7), (3, 7)} <= got and broken != other


def test_scripts_without_spaces(spark):
    text = "小明有十二个苹果,小红从他那里买了三个苹果,然后小明又卖给她四个梨,请问现在小红一共有多少个苹果"
    changed = text.replace("梨", "桃").replace("请问", "请你问")
    docs = spark.createDataFrame([(1, text), (2, "前面的文字。" + changed), (3, "完全不同的一段中文文字,没有任何题目在里面,只是普通的句子而已")], "doc_id BIGINT, text STRING")
    item = spark.createDataFrame([(7, text)], "item_id BIGINT, text STRING")
    assert {r["doc_id"] for r in decontaminate.find_leaks(docs, item).collect()} == {1, 2}
