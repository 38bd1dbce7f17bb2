"""Registered queries of the training-data operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, divergence, langid, minhash, packing, phrases, pii, quality, topk, urlfilter, warc
from .shared import shared_folder, staged, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RANKS, VOCABULARY = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def query(key: str, oracle: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn

    return register


def fold(id_col: str, parts: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % parts


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = staged(quality.document_statistics(docs), "statistics")
    taught = labels.filter(fold("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(stats, quality.fit(stats.join(taught, "doc_id")))
    return scored.select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query(
    "op2_topk",
    """
    WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
    s AS (
      SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.row <> q.row
    ),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "id % 50 = 0", k=5)


_ESCAPES = r"\### Assistant: </turn> ok"


@query(
    "op3_chat",
    r"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    ),
    p AS (
      SELECT *, row_number() OVER w - 1 AS pos,
        len(regexp_extract_all(text, '[^\x09-\x0D\x20]+')) + 4 AS tokens,
        8 + length(replace(regexp_replace(role, '([\\#:])', '\\\1', 'g'), '</turn>', '<\/turn>')) - 2
          + length(replace(regexp_replace(text, '([\\#])', '\\\1', 'g'), '</turn>', '<\/turn>')) + 8 AS size
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
    ),
    m AS (SELECT *, pos = 0 AND role = 'system' AS sys, CASE WHEN pos = 0 AND role = 'system' THEN 0 ELSE tokens END AS own FROM p),
    e AS (SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS stop FROM m),
    k AS (
      SELECT *, stop - own AS start, (stop - own) // 512 AS cell, NOT sys AND (stop - 1) // 512 > (stop - own) // 512 AS crossing FROM e
    ),
    w AS (SELECT conv_id, cell, crossing, min(pos) AS win, min(start) FILTER (NOT sys) AS first FROM k GROUP BY ALL),
    f AS (
      SELECT conv_id, size FROM k
      UNION ALL SELECT w.conv_id, k.size FROM w JOIN k ON k.conv_id = w.conv_id AND k.sys AND w.win > 0
      UNION ALL SELECT w.conv_id, k.size FROM w JOIN k ON k.conv_id = w.conv_id AND NOT k.sys AND k.pos < w.win AND w.first - k.start <= 128
    ),
    t AS (
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
        coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss
      FROM k GROUP BY conv_id
    )
    SELECT t.conv_id, t.n_turns, t.turns_sha256, CAST(length(t.loss) AS BIGINT) AS loss_chars, sha256(t.loss) AS loss_sha256, x.formatted_chars
    FROM t JOIN (SELECT conv_id, CAST(sum(size) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id) x ON x.conv_id = t.conv_id
    """,
)
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).cast("bigint").alias("turn"), F.lit("assistant").alias("role")),
    )).alias("t")).select(F.lit(-7).cast("bigint").alias("conv_id"), "t.turn", "t.role", F.lit(_ESCAPES).alias("text"))
    windows = chat.format_windows(turns.unionByName(added))
    new = F.slice(chat.read_turns(F.col("formatted")), F.col("n_repeated") + 1, F.col("n_turns"))
    back = windows.select(
        "conv_id", "window", new.alias("new"), F.length("formatted").alias("size"),
        F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    said = F.array_join(F.transform("new", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # The digests are of whole conversations, so one conversation's text meets here
    whole = back.select("conv_id", "size", F.size("new").alias("n"), F.struct("window", said.alias("said"), "loss").alias("w")).groupBy("conv_id").agg(
        F.sum("n").cast("bigint").alias("n_turns"), F.array_sort(F.collect_list("w")).alias("w"), F.sum("size").cast("bigint").alias("formatted_chars"))
    joined = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    return whole.select("conv_id", "n_turns", joined("said").alias("said"), joined("loss").alias("loss"), "formatted_chars").select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(RANKS)
    coded = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return coded.select("doc_id", "ids", bpe.decode(F.col("ids"), path).alias("decoded")).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op5_minhash")
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@query("op6_decontaminate")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_langid")
def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs.filter(fold("doc_id", 4) != 2)))
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score", "languages")


def _hex(text: str, at: int) -> Column:
    return F.expr(f"(locate(substr(md5({text}), {at}, 1), '0123456789abcdef') - 1)")


def url_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of ``pages``: host entries with a later entry for some, parent domains, first path segments."""
    day = lambda text, at: F.date_add(F.to_date(F.lit("2024-01-01")), (_hex(text, at) * 16 + _hex(text, at + 1)).cast("int"))
    seen = pages.select(urlfilter.host_of(F.col("url")).alias("host"), F.element_at(F.split(urlfilter.path_of(F.col("url")), "/"), 1).alias("top"))
    hosts = seen.filter("host <> ''").select("host").distinct()
    block = F.lit("block").alias("action")
    listed = hosts.filter(_hex("host", 1) < 4).select(F.col("host").alias("pattern"), block, day("host", 2).alias("listed_on"))
    lifted = hosts.filter((_hex("host", 1) < 4) & (_hex("host", 4) < 8)).select(F.col("host").alias("pattern"), F.lit("allow").alias("action"), day("host", 5).alias("listed_on"))
    parents = hosts.select(F.substring_index("host", ".", -3).alias("p")).distinct().filter(_hex("p", 7) < 2).select(F.col("p").alias("pattern"), block, day("p", 8).alias("listed_on"))
    tops = seen.filter("host <> '' and top <> ''").select(F.concat_ws("/", "host", "top").alias("p")).distinct().filter(_hex("p", 10) < 3).select(
        F.col("p").alias("pattern"), F.when(_hex("p", 11) < 8, "allow").otherwise("block").alias("action"), day("p", 12).alias("listed_on"))
    return listed.unionByName(lifted).unionByName(parents).unionByName(tops)


def _sql_hex(text: str, at: int) -> str:
    return f"(strpos('0123456789abcdef', substr(md5({text}), {at}, 1)) - 1)"


def _sql_day(text: str, at: int) -> str:
    return f"(DATE '2024-01-01' + CAST({_sql_hex(text, at)} * 16 + {_sql_hex(text, at + 1)} AS INTEGER))"


_OP8_SQL = f"""
    WITH p AS (
      SELECT page_id, url, {_sql_day("url", 1)} AS fetched_on,
        regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\\.$', '') AS host,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^?#]*)', 1) AS path
      FROM pages
    ),
    h AS (SELECT DISTINCT host FROM p WHERE host <> ''),
    d AS (SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 2, 1), len(string_split(host, '.'))), '.') AS q FROM h),
    t AS (SELECT DISTINCT host || '/' || split_part(path, '/', 1) AS q FROM p WHERE host <> '' AND split_part(path, '/', 1) <> ''),
    e AS (
      SELECT host AS pattern, 'block' AS action, {_sql_day("host", 2)} AS listed_on FROM h WHERE {_sql_hex("host", 1)} < 4
      UNION ALL SELECT host, 'allow', {_sql_day("host", 5)} FROM h WHERE {_sql_hex("host", 1)} < 4 AND {_sql_hex("host", 4)} < 8
      UNION ALL SELECT q, 'block', {_sql_day("q", 8)} FROM d WHERE {_sql_hex("q", 7)} < 2
      UNION ALL SELECT q, CASE WHEN {_sql_hex("q", 11)} < 8 THEN 'allow' ELSE 'block' END, {_sql_day("q", 12)} FROM t WHERE {_sql_hex("q", 10)} < 3
    ),
    g AS (SELECT pattern, listed_on, max(action) AS action FROM e GROUP BY ALL),
    i AS (SELECT pattern, action, listed_on AS valid_from, lead(listed_on) OVER (PARTITION BY pattern ORDER BY listed_on) AS valid_to FROM g),
    k AS (SELECT DISTINCT url, fetched_on, host, path FROM p WHERE host <> ''),
    s AS (SELECT *, string_split(host, '.') AS ls, list_filter(string_split(path, '/'), lambda x: x <> '') AS ps FROM k),
    x AS (
      SELECT url, fetched_on, unnest(list_concat(
        list_transform(range(1, len(ls) + 1), lambda n: array_to_string(list_slice(ls, n, len(ls)), '.')),
        list_transform(range(1, len(ps) + 1), lambda n: host || '/' || array_to_string(list_slice(ps, 1, n), '/')))) AS pattern
      FROM s
    ),
    r AS (
      SELECT x.url, x.fetched_on, x.pattern, i.action, row_number() OVER (
        PARTITION BY x.url, x.fetched_on ORDER BY contains(x.pattern, '/') DESC, length(x.pattern) DESC, x.pattern DESC, i.action DESC) AS n
      FROM x JOIN i ON i.pattern = x.pattern AND i.valid_from <= x.fetched_on AND (i.valid_to IS NULL OR x.fetched_on < i.valid_to)
    )
    SELECT p.page_id, CAST(p.fetched_on AS VARCHAR) AS fetched_on, coalesce(r.action = 'block', FALSE) AS blocked, r.pattern, r.action
    FROM p LEFT JOIN r ON r.n = 1 AND r.url = p.url AND r.fetched_on = p.fetched_on
    """


@query("op8_urlfilter", _OP8_SQL)
def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (_hex("url", 1) * 16 + _hex("url", 2)).cast("int"))
    judged = urlfilter.filter_urls(pages.withColumn("fetched_on", day), url_entries(pages))
    return judged.select("page_id", F.col("fetched_on").cast("string").alias("fetched_on"), "blocked", "pattern", "action")


_OP9_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
    f AS (SELECT hex, min(page_id) AS first FROM h GROUP BY hex)
    SELECT page_id, payload_bytes,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST((CAST('0x' || substr(hex, 5 * CAST(i // 4 AS INTEGER) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
      CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
    FROM h JOIN f USING (hex)
    """


@query("op9_warc", _OP9_SQL)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = warc.write_archives(pages, shared_folder(spark, "warc"), "page_id", F.col("html"), F.col("url"))
    back = warc.read_archives(archives, with_payload=False)
    return back.select(
        warc.row_id(F.col("record_id")).cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.row_id(F.col("refers_to")).cast("bigint").alias("refers_to"))


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query("op11_packing")
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), digest=True)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


_OP12_SQL = r"""
    WITH d AS (
      SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS terms
      FROM documents
    ),
    t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
    k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
    v AS (SELECT g.lang, count(k.term) AS kept FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN k USING (lang) GROUP BY g.lang),
    c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
    g AS (
      SELECT a.lang, a.source, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) a
      LEFT JOIN c ON c.lang = a.lang AND c.source = a.source GROUP BY ALL
    ),
    p AS (
      SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST((1000000000 * CAST(coalesce(c.n, 0) + 2 AS HUGEINT)) // (g.total + 2 * v.kept) AS BIGINT) AS p
      FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
    ),
    w AS (SELECT lang, term, sum(n) AS n FROM p GROUP BY ALL),
    q AS (
      SELECT w.lang, w.term, 1 + CAST((1000000000 * CAST(w.n + 2 AS HUGEINT)) // (s.total + 2 * v.kept) AS BIGINT) AS q
      FROM w JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY lang) s USING (lang)
    ),
    f AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
        SELECT a.lang, a.source AS sa, b.source AS sb, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
      ) x ON x.lang = a.lang AND x.sa = a.source AND x.sb = b.source
      UNION ALL
      SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q
    ),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
    """


@query("op12_divergence", _OP12_SQL)
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


_OP13_SQL = r"""
    WITH d AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents
    ),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
    n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
    g AS (
      SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase FROM (
        SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
      )
    ),
    f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
    x AS (
      SELECT lang, k, phrase, a FROM f WHERE k > 1 AND NOT EXISTS (
        SELECT 1 FROM f AS o WHERE o.lang = f.lang AND o.k > f.k AND 100 * o.a >= 100 * f.a AND contains(' ' || o.phrase || ' ', ' ' || f.phrase || ' '))
    ),
    c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM x),
    s AS (
      SELECT c.lang, c.phrase, c.a, c.cut, l.a AS l, r.a AS r, n.n, CAST((1000 * CAST(c.a AS HUGEINT) * n.n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
      FROM c JOIN n ON n.lang = c.lang
      JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.ws, 1, c.cut), ' ')
      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.ws, c.cut + 1, c.k), ' ')
    ),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS i FROM s) WHERE i = 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
    SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
    """


@query("op13_phrases", _OP13_SQL)
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))
