"""Packing, divergence of sources and phrases against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm import divergence, packing, phrases, queries

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Nulls, empty and long texts, repeated rows, columns named like those the operators add
ODD_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n BIGINT, term STRING, piece STRING, length STRING, slot STRING, phrase STRING"
ODD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n", None, "a"), (4, "the and of " * 20_000, "en", "a"), (5, "Same TEXT, in two rows", "en", "b"),
    (5, "Same TEXT, in two rows", "en", "b"), (None, "no id here", "en", "b"), (7, "12345 !!! 678", "en", "b"), (8, "été À la plage <|endoftext|>", "fr", "b"),
    (9, "x" * 5_000, None, None), (10, " " * 5_000 + "end", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 7, "t", "p", "l", "s", "q") for r in ODD], ODD_SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


# Packing


def ids_of(text, library=[]):
    if not library:
        library.append(Tokenizer.from_file(VOCABULARY))
        library[0].encode_special_tokens = True
    return library[0].encode(text or "", add_special_tokens=False).ids + [2]


def assert_packed(rows, docs, size):
    """Every document once, cut as agreed; sequences without gaps, not overfull, one name each."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["crc"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for doc, text in docs:
        ids = ids_of(text)
        first = len(ids) % size or min(size, len(ids))
        bounds = [0, *range(first, len(ids) + 1, size)]
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[doc].append((i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence)


@pytest.mark.parametrize("size", [1024, 100])
def test_packing_of_all_documents(spark, documents, size):
    packed = packing.pack_documents(documents, VOCABULARY, size).withColumn("crc", F.crc32("ids")).collect()
    n = assert_packed(packed, [tuple(r) for r in documents.select("doc_id", "text").collect()], size)
    lengths = np.array([r["length"] for r in packed])
    assert n <= len(packing.best_fit(lengths, size)) * 1.01 + 1 and n >= -(-lengths.sum() // size)


def test_packing_query(spark):
    rows = queries.QUERIES["op11_packing"](spark, SF).withColumnRenamed("ids_crc32", "crc").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert_packed(rows, [tuple(r) for r in docs], 1024)


def test_packing_in_many_rounds(spark, monkeypatch):
    """Small rounds, few carried bins and many partitions: all pieces are placed once, and few places stay free."""
    monkeypatch.setattr(packing, "LOCAL", 50)
    monkeypatch.setattr(packing, "CARRIED", 12)
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rnd = random.Random(4)
    lengths = [rnd.randint(1, 64) for _ in range(3000)]
    cut = spark.createDataFrame(list(enumerate(lengths)), "piece_key BIGINT, length BIGINT").repartition(13)
    cut = packing.staged(cut, "cut")
    rows = packing.pack(cut, 64).collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(r["piece_key"] for r in rows) == list(range(3000))
    for parts in by_sequence.values():
        assert [o for o, _ in sorted(parts)] == list(np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1]) and sum(n for _, n in parts) <= 64
    assert len(by_sequence) <= 1.05 * -(-sum(lengths) // 64)


def test_packing_odd_rows(spark, odd):
    packed = packing.pack_documents(odd, VOCABULARY, 64).withColumn("crc", F.crc32("ids")).collect()
    assert_packed(packed, [r[:2] for r in ODD], 64)
    assert packing.pack_documents(empty(spark), VOCABULARY).count() == 0
    kept = packing.pieces(odd, VOCABULARY, end=None, keep=["lang"])
    assert kept.filter("doc_id in (1, 2)").count() == 0 and kept.columns == ["doc_id", "lang", "piece", "start", "length", "ids"]


def test_sequences_hold_the_documents_ids(spark, documents):
    packed = packing.staged(packing.pack_documents(documents.limit(40), VOCABULARY, 256), "packed")
    whole = {r["sequence_id"]: (np.frombuffer(r["ids"], "<u4").tolist(), r["lengths"]) for r in packing.sequences(packed).collect()}
    back = defaultdict(list)
    for r in packed.collect():
        ids, lengths = whole[r["sequence_id"]]
        assert sum(lengths) == len(ids) <= 256
        back[r["doc_id"]].append((r["start"], ids[r["offset"] : r["offset"] + r["length"]]))
    for r in documents.limit(40).collect():
        assert sum((x for _, x in sorted(back[r["doc_id"]])), []) == ids_of(r["text"])


@pytest.mark.parametrize("seed", range(3))
def test_best_fit_takes_the_fullest_bin_with_room(seed):
    rnd = random.Random(seed)
    lengths = np.array([rnd.randint(1, 40) for _ in range(200)])
    rooms = []
    for n in sorted(lengths.tolist(), reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((40 if fit is None else fit) - n)
    bins = packing.best_fit(lengths, 40)
    assert sorted(i for b in bins for i in b) == list(range(200))
    assert sorted(40 - lengths[b].sum() for b in bins) == sorted(rooms)


# Divergence


def audit_of(rows, least):
    """The contract word by word, in Python's whole numbers."""
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    rows = [(lang or "", source or "", term.findall(low(text or ""))) for _, text, lang, source in rows]
    frequency, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in rows:
        frequency[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {r[0] for r in rows}:
        kept = [t for t, n in frequency[lang].items() if n >= least]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        p = lambda count, total: 1 + 1_000_000_000 * (count + 2) // (total + 2 * len(kept))
        total = {s: sum(c[t] for t in kept) for s, c in groups.items()}
        share = {s: {t: p(c[t], total[s]) for t in kept} for s, c in groups.items()}
        whole = {t: p(sum(c[t] for c in groups.values()), sum(total.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in groups.items():
            pairs = [(o, sum(f(share[s][t], share[o][t]) for t in kept)) for o in groups if o != s]
            high = [(t, f(share[s][t], whole[t])) for t in kept if c[t] > 0 and share[s][t] > whole[t]]
            for part, found, top in (("pair", pairs, None), ("term", high, 10)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ordered)]
    return sorted(out)


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


@pytest.mark.parametrize("shard, tile, pack", [(8192, 256, 1 << 20), (50, 3, 2000)])
def test_divergence_of_all_documents(spark, documents, monkeypatch, shard, tile, pack):
    """Also with many shards, several broadcasts and several tiles of sources."""
    for name, value in (("SHARD", shard), ("TILE", tile), ("PACK_BYTES", pack), ("HELD_TERMS", 5000 if shard < 100 else 400_000)):
        monkeypatch.setattr(divergence, name, value)
    got = divergence.audit(documents).select(COLUMNS).collect()
    want = audit_of([tuple(r) for r in documents.select("doc_id", "text", "lang", "source").collect()], 10)
    assert sorted(map(tuple, got)) == want and len(want) > 1000


def test_divergence_odd_rows(spark, odd):
    for least in (1, 2, 1000):
        assert sorted(map(tuple, divergence.audit(odd, least).select(COLUMNS).collect())) == audit_of([r[:4] for r in ODD], least)
    assert divergence.audit(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 100, 3000])
def test_perfect_hash_has_no_gaps(n):
    terms = [f"term{i}é".encode() for i in range(n)]
    shifts, slots = divergence.perfect_hash(terms)
    assert sorted(slots.tolist()) == list(range(n)) and len(shifts) == -(-n // divergence.BUCKET)


def test_lookup_finds_its_terms_and_no_others(spark):
    terms = [f"word{i}" for i in range(1000)]
    rows = spark.createDataFrame([("en", t.encode()) for t in terms], "lang STRING, term BINARY")
    divergence_shards = [r.asDict() for r in divergence.hash_shards(rows).collect()]
    look = divergence.Lookup([s | {c: bytes(s[c]) for c in ("shifts", "terms", "ends")} for s in divergence_shards])
    assert sorted(look.slots([t.encode() for t in terms]).tolist()) == list(range(1000))
    assert (look.slots([f"other{i}".encode() for i in range(1000)]) == -1).all()


def test_shares_are_exact_beyond_64_bits():
    rnd = random.Random(1)
    pairs = [(c, n) for n in (3, 10**6 + 3, 10**12 + 39, 9 * 10**15) for c in (0, 1, 2, n // 3, n - 1, n, rnd.randrange(n))]
    for count, total in pairs:
        assert divergence.share(np.array([count]), total)[0] == 1 + 10**9 * count // total


# Phrases


def phrases_of(rows, least, top=2000):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    words, counts = Counter(), defaultdict(Counter)
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", low(text or "")):
            ws = re.findall("[^ \t]+", piece)
            words[lang] += len(ws)
            for k in range(1, 6):
                counts[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {q[i : i + k] for q, a in kept.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * a >= 100 * f[q[i : i + k]]}
        scored = []
        for p, a in kept.items():
            if p not in inside:
                cut = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-cut[0], -a, " ".join(p).encode(), f[p[: cut[1]]], f[p[cut[1] :]]))
        for i, (score, a, p, l, r) in enumerate(sorted(scored)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, words[lang], -score))
    return sorted(out)


PHRASE = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("least, slots, step", [(100, 1 << 26, 1 << 16), (5, 1 << 16, 1000), (300, 1 << 20, 7)])
def test_phrases_of_all_documents(spark, documents, monkeypatch, least, slots, step):
    """Also with a sketch so small that it prunes next to nothing, tiny steps, and counters of four bytes."""
    monkeypatch.setattr(phrases, "STEP_WORDS", step)
    monkeypatch.setattr(phrases, "HELD", 3000)
    docs = documents if step > 10 else documents.orderBy("doc_id").limit(2).withColumn("text", F.repeat(F.concat(F.substring("text", 1, 700), F.lit(" ")), 310))
    got = phrases.collocations(docs, least, slots=slots).select(PHRASE).collect()
    want = phrases_of([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], least)
    assert sorted(map(tuple, got)) == want and len(want) > 20


def test_phrases_odd_rows(spark, odd):
    for least in (1, 2):
        got = phrases.collocations(odd, least, slots=1 << 16).select(PHRASE).collect()
        assert sorted(map(tuple, got)) == phrases_of([r[:3] for r in ODD], least)
    assert phrases.collocations(empty(spark), slots=1 << 16).count() == 0


def test_top_and_ties(spark):
    docs = spark.createDataFrame([("b a c d. " * 3 + "é a z",)], "text STRING").withColumn("lang", F.lit("en"))
    got = phrases.collocations(docs, 1, top=2, slots=1 << 16).select(PHRASE).collect()
    assert sorted(map(tuple, got)) == phrases_of([(0, docs.first()["text"], "en")], 1, 2)


def test_unary_paths_spell_repeated_passages(spark):
    """A passage of 60 words in 7 texts is one path; each edge of the graph is on one path."""
    rnd = random.Random(6)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([f"a{rnd.randrange(9)}" for _ in range(8)] + passage + [f"b{rnd.randrange(9)}" for _ in range(8)]) for _ in range(7)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text STRING, lang STRING")
    flow = phrases.node_flow(phrases.staged(phrases.gram_records(docs, 2, slots=1 << 16), "records"))
    edges = flow[5].filter("n >= 2")
    paths = phrases.compact_paths(edges, flow[4]).collect()
    assert " ".join(passage) in {r["phrase"] for r in paths if r["n"] == 7}
    spelled = Counter(tuple(w[i : i + 5]) for w in (r["phrase"].split(" ") for r in paths) for i in range(len(w) - 4))
    assert spelled == Counter(tuple(r["phrase"].split(" ")) for r in edges.collect()) and all(r["words"] == len(r["phrase"].split(" ")) for r in paths)
