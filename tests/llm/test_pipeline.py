"""The corpus pipeline against a brute-force version in plain Python."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_operators import brute_components, brute_spans, encoder, re

import corpus_pipeline
from tidewater.llm import langid

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    letters, counts = langid._letters(), {}
    for r in docs:
        counts.setdefault(r.lang, np.full(langid.BUCKETS, langid.SMOOTHING))
        np.add.at(counts[r.lang], langid.trigrams(r.text.encode(), letters), 1)
    table = np.stack([(counts[x] / counts[x].sum()).astype(np.float32) for x in sorted(counts)], axis=1)
    kept = []
    for r in docs:
        grams = langid.trigrams(r.text.encode(), letters)
        if len(grams):
            best, share, _ = langid.infer(grams, table, 2.0)
            if share[best] >= corpus_pipeline.LEAST_SHARE:
                kept.append(r)
    groups = brute_components([(r.doc_id, r.text) for r in kept], 5, 80)
    kept = [r for r in kept if groups[r.doc_id][1] == r.doc_id]
    norm = lambda t: " " + " ".join(w for w in re.split(r"[\W_]+", t.lower()) if w) + " "
    asked = [norm(t) for t in items]
    kept = [r for r in kept if not any(q in norm(r.text) for q in asked)]
    enc, want = encoder(), {}
    for r in kept:
        clean, at = "", 0
        for a, _, b, kind in brute_spans(r.text):
            if a >= at:
                clean += r.text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        want[r.doc_id] = enc.encode_ordinary(clean + r.text[at:])
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in out} == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out)


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    rows = [
        (1, None, "en", "s", 0), (2, "", None, None, None), (3, "the and of to in " * 9, "en", "s", 5), (3, "the and of to in " * 9, "en", "s", 5),
        (None, "the and is in the text mail a@b.cd now", "en", "s", 1), (5, "123 456", "en", "s", 7), (6, "le la les des un une et " * 3000, "fr", "s", 9),
    ]
    df = spark.createDataFrame(rows, schema)
    for source in (df, df.limit(0)):
        docs = source
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == df.columns, name
        docs = docs.cache()
        if source is df:
            assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 3, 6]
            assert docs.filter("doc_id is null").first().text == "the and is in the text mail [EMAIL] now"
        out = corpus_pipeline.tokens(spark, docs, SF)
        assert out.count() == docs.count() and out.filter(~F.col("round_trip")).count() == 0
    assert public_tokenizers.PATTERN and [n for n, _ in corpus_pipeline.STAGES][1] == "near_duplicates"


def test_language_rejects_what_was_not_learned(spark):
    rng = np.random.default_rng(3)
    odd = [
        "Съешь ещё этих мягких французских булок да выпей же чаю", "これは日本語の文章です。東京は大きな都市です。", " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(80)),
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    added = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(odd)], docs.schema)
    # With all languages, and with one alone
    for learned in (docs, docs.filter("lang = 'en'")):
        kept = {r.doc_id for r in corpus_pipeline.language(spark, learned.unionByName(added), SF).collect()}
        assert kept == {r.doc_id for r in learned.collect()}


def test_rows_that_share_an_id_or_have_none_are_judged_by_their_texts(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    first, second, third = (" ".join(f"{w}{i}" for i in range(40)) for w in ("one", "two", "three"))
    rows = [(1, first), (1, second), (None, third), (None, third), (None, first), (2, second), (3, f"so {item}"), (3, "the clean row"), (None, f"so, {item} so"), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    have = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    gone = [(None, third), (None, first), (2, second)]
    want = [r for i, r in enumerate(rows) if not (r in gone and i != 2)]
    # The two rows with the item are near-duplicates where the item is long
    assert [r for r in have(kept) if item not in (r[1] or "")] == sorted([r for r in want if item not in (r[1] or "")], key=str)
    clean = corpus_pipeline.decontamination(spark, docs, SF)
    assert have(clean) == sorted([r for r in rows if item not in (r[1] or "")], key=str)
