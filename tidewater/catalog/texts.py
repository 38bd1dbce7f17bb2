"""Text cleaning, chunking, vector search, prompts and the privacy policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fx
from ..functions import text as tx
from ..operators import governance as gv
from ..operators import retrieval as rt
from ..operators import vector_index
from .base import query, r6, table

_CTRL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


@query(
    "sanitize_text",
    rf"SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace(text, '{_CTRL}', '', 'g'), '(?s)```.*?```', '', 'g'), E' \n\t\r'), '\n{{3,}}', E'\n\n', 'g') AS markdown, "
    rf"regexp_replace(regexp_replace(trim(regexp_replace(text, '{_CTRL}', '', 'g'), E' \n\t\r'), '\n{{3,}}', E'\n\n', 'g'), '[ \t]{{2,}}', ' ', 'g') AS page FROM documents",
)
def sanitize_text(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", tx.sanitize_markdown(F.col("text")).alias("markdown"), tx.sanitize_page(F.col("text")).alias("page")
    )


@query(
    "scrub_pii",
    "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '" + fx.PHONE_PATTERN + "', '[PHONE]', 'g'), '" + fx.EMAIL_PATTERN + "', '[EMAIL]', 'g'), '" + fx.COORD_PATTERN + "', '[COORD]', 'g') AS text FROM documents",
)
def scrub_pii(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.scrub_pii(F.col("text")).alias("text"))


_MD = r"regexp_replace(regexp_replace(regexp_replace(html, '<h[1-3][^>]*>', E'\n## ', 'g'), '</(h[1-3]|p|li|div)>', E'\n', 'g'), '<[^>]+>', '', 'g')"


def pages_markdown(spark, d):
    """Page text with headings turned into markdown heading lines."""
    md = F.regexp_replace("html", "<h[1-3][^>]*>", "\n## ")
    md = F.regexp_replace(F.regexp_replace(md, "</(h[1-3]|p|li|div)>", "\n"), "<[^>]+>", "")
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), md.alias("body"))


@query(
    "split_sections",
    rf"""WITH m AS (SELECT page_id, 'page ' || CAST(page_id AS VARCHAR) AS title, regexp_replace(regexp_replace({_MD}, '{_CTRL}', '', 'g'), '(?m)^(#{{1,3}}[ \t]+[^\n]+)$', chr(30) || '\1', 'g') AS body FROM pages),
    s AS (SELECT page_id, title, unnest(string_split(body, chr(30))) AS s, unnest(range(len(string_split(body, chr(30))))) AS section_no FROM m),
    h AS (SELECT *, section_no > 0 AND regexp_matches(s, '^#{{1,3}}[ \t]+[^\n]+') AS heading FROM s),
    c AS (SELECT page_id, CAST(section_no AS INT) AS section_no, CASE WHEN heading THEN trim(ltrim(trim(regexp_extract(s, '^#{{1,3}}[ \t]+([^\n]+)', 1)), '#')) ELSE title END AS section_title, regexp_replace(trim(regexp_replace(CASE WHEN heading THEN regexp_replace(s, '^#{{1,3}}[ \t]+[^\n]+\n?', '') ELSE s END, '(?s)```.*?```', '', 'g'), E' \n\t\r'), '\n{{3,}}', E'\n\n', 'g') AS content FROM h)
    SELECT page_id, section_no, section_title, content FROM c WHERE length(content) >= 40""",
)
def split_sections(spark, d):
    s = rt.split_sections(pages_markdown(spark, d), ["page_id"], "title", "body")
    return s.select("page_id", "section_no", "section_title", "content")


_PACKED = """list_reduce(list_transform(string_split_regex({src}, '{sep}'), lambda s0: [s0]), lambda a, x: CASE WHEN length(a[-1]) + length(x[1]) + 1 <= 1200 THEN list_append(a[:-2], CASE WHEN a[-1] = '' THEN x[1] ELSE a[-1] || '{glue}' || x[1] END)
  WHEN a[-1] = '' THEN list_append(a[:-2], x[1]) ELSE list_append(a, x[1]) END, [''])"""
_SENTENCES = _PACKED.format(src=r"regexp_replace(p[1], '([.!?다])\s+', '\1' || chr(30), 'g')", sep=r"\x1e", glue=" ")
_CHUNKS = rf"""paras AS (SELECT doc_id, text, list_transform(list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda q: trim(q, E' \n\t\r')), lambda q: q <> ''), lambda q: [q]) AS ps FROM documents),
 packed AS (SELECT doc_id, CASE WHEN length(text) <= 1200 THEN [text] ELSE list_reduce(ps, lambda b, p: CASE WHEN length(b[-1]) + length(p[1]) + 1 <= 1200 THEN list_append(b[:-2], CASE WHEN b[-1] = '' THEN p[1] ELSE b[-1] || E'\n' || p[1] END)
   WHEN length(p[1]) <= 1200 THEN CASE WHEN b[-1] = '' THEN list_append(b[:-2], p[1]) ELSE list_append(b, p[1]) END
   ELSE list_append(list_concat(CASE WHEN b[-1] = '' THEN b[:-2] ELSE b END, list_filter({_SENTENCES}, lambda z: z <> '')), '') END, ['']) END AS cs FROM paras),
 chunks AS (SELECT doc_id, CAST(i AS INT) AS chunk_no, c AS content FROM (SELECT doc_id, unnest(cs) AS c, unnest(range(len(cs))) AS i FROM packed) WHERE length(c) >= 40)"""


def chunks(spark, d):
    return rt.chunk_documents(table(spark, d, "documents"), ["doc_id"], "text")


@query("chunk_documents", f"WITH {_CHUNKS} SELECT doc_id, chunk_no, content FROM chunks")
def chunk_documents(spark, d):
    return chunks(spark, d)


@query(
    "section_chunks",
    rf"""WITH m AS (SELECT page_id, 'page ' || CAST(page_id AS VARCHAR) AS title, regexp_replace(regexp_replace({_MD}, '{_CTRL}', '', 'g'), '(?m)^(#{{1,3}}[ \t]+[^\n]+)$', chr(30) || '\1', 'g') AS body FROM pages),
    s AS (SELECT page_id, title, unnest(string_split(body, chr(30))) AS s, unnest(range(len(string_split(body, chr(30))))) AS section_no FROM m),
    h AS (SELECT *, section_no > 0 AND regexp_matches(s, '^#{{1,3}}[ \t]+[^\n]+') AS heading FROM s),
    c AS (SELECT page_id, title, CAST(section_no AS INT) AS section_no, CASE WHEN heading THEN trim(ltrim(trim(regexp_extract(s, '^#{{1,3}}[ \t]+([^\n]+)', 1)), '#')) ELSE title END AS section_title, regexp_replace(trim(regexp_replace(CASE WHEN heading THEN regexp_replace(s, '^#{{1,3}}[ \t]+[^\n]+\n?', '') ELSE s END, '(?s)```.*?```', '', 'g'), E' \n\t\r'), '\n{{3,}}', E'\n\n', 'g') AS content FROM h),
    documents AS (SELECT page_id * 10000 + section_no AS doc_id, content AS text FROM c WHERE length(content) >= 40),
    {_CHUNKS}
    SELECT c.page_id, c.section_no, k.chunk_no, CASE WHEN section_title = title THEN title ELSE title || ' — ' || section_title END AS title, k.content
    FROM chunks k JOIN c ON c.page_id * 10000 + c.section_no = k.doc_id""",
)
def section_chunks(spark, d):
    """Pages cut into sections, sections into chunks, titled by page and section."""
    return rt.section_chunks(pages_markdown(spark, d), ["page_id"], "title", "body")


@query("chunk_ids", f"WITH {_CHUNKS}, n AS (SELECT *, row_number() OVER (ORDER BY doc_id, chunk_no) - 1 AS i FROM chunks) SELECT doc_id, chunk_no, 'doc_' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 4, '0') ELSE CAST(i AS VARCHAR) END AS chunk_id, 'doc ' || CAST(doc_id AS VARCHAR) || E'\\n' || content AS index_text FROM n")
def chunk_ids(spark, d):
    titled = chunks(spark, d).withColumn("title", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    return rt.assign_chunk_ids(titled, [("doc_id", True), ("chunk_no", True)]).select("doc_id", "chunk_no", "chunk_id", "index_text")


_TOP = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM e), q0 AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2), q AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY i) AS v FROM q0 GROUP BY 1),
 s AS (SELECT query_id, vec_id AS doc_id, 1 - list_cosine_similarity(e.v, q.v) AS distance FROM q CROSS JOIN e), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM s),
 top AS (SELECT query_id, doc_id, distance, CAST(rank AS INT) AS rank FROM k WHERE rank <= 3)"""


def top_documents(spark, d, k=3):
    """Nearest vectors of each label's mean vector (one query per label)."""
    e = table(spark, d, "embeddings")
    parts = e.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    queries = means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(F.transform(ordered, lambda s: s.x).alias("vector"))
    docs = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rt.cosine_topk(queries, docs, k)


@query("cosine_topk", f"WITH {_TOP} SELECT query_id, doc_id, round(distance, 6) AS distance, rank FROM top")
def cosine_topk(spark, d):
    return top_documents(spark, d).select("query_id", "doc_id", r6("distance"), F.col("rank").cast("int").alias("rank"))


@query("cosine_topk_index")
def cosine_topk_index(spark, d):
    """Nearest three of every hundredth vector, itself included, by the projection index."""
    docs = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    queries = docs.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    found = vector_index.cosine_topk_index(queries, docs)
    return found.select("query_id", "doc_id", r6("distance"), F.col("rank").cast("int").alias("rank"))


def retrieved(spark, d):
    """Ranked documents per query as an array of at most three structs."""
    docs = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), "source", F.col("text").alias("content")
    )
    found = top_documents(spark, d).join(docs, "doc_id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "title", "source", "content")))
    return found.groupBy("query_id").agg(ordered.alias("docs"))


_DOCS = _TOP + ", r AS (SELECT query_id, rank, 'doc ' || CAST(x.doc_id AS VARCHAR) AS title, coalesce(source, '?') AS source, text FROM top t JOIN documents x ON x.doc_id = t.doc_id)"


@query(
    "prompt_context",
    f"WITH {_DOCS}, o AS (SELECT query_id, string_agg('[참고 ' || CAST(k AS VARCHAR) || '] ' || title || ' (출처: ' || source || E')\\n' || text, E'\\n\\n' ORDER BY rank) AS body FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM r) GROUP BY 1) "
    "SELECT query_id, E'\\n\\n[현재 양식장 센서 상태]\\nlabel: ' || CAST(query_id AS VARCHAR) || E'\\n\\n[참고 문서]\\n' || body || E'\\n\\n[질문]\\nlabel ' || CAST(query_id AS VARCHAR) || E'\\n\\n" + fx.PROMPT_CLOSING + "' AS prompt FROM o",
)
def prompt_context(spark, d):
    r = retrieved(spark, d)
    name = F.col("query_id").cast("string")
    return r.select("query_id", rt.build_prompt(F.concat(F.lit("label "), name), F.col("docs"), F.concat(F.lit("label: "), name)).alias("prompt"))


@query(
    "template_answer",
    f"WITH {_DOCS}, o AS (SELECT query_id, arg_min(text, rank) AS top, string_agg('  - ' || title || ' (출처: ' || source || ')', E'\\n' ORDER BY rank) AS refs FROM r GROUP BY 1) "
    "SELECT query_id, array_to_string(string_split(top, '. ')[1:3], '. ') || E'\\n\\n[참고 문서]\\n' || refs || E'\\n\\n" + fx.ANSWER_CLOSING + "' AS answer FROM o",
)
def template_answer(spark, d):
    return retrieved(spark, d).select("query_id", rt.template_answer(F.col("docs")).alias("answer"))


@query("doc_catalog", "SELECT doc_id, 'doc ' || CAST(doc_id AS VARCHAR) AS title, source, lang, n_chars, length(text) AS n_code_points FROM documents")
def doc_catalog(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), "source", "lang", "n_chars", F.length("text").cast("bigint").alias("n_code_points")
    )


@query("anonymize_ids", "SELECT c_custkey, 'FARM_' || upper(substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8)) AS farm_ref FROM customer")
def anonymize_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.anonymous_id(F.col("c_custkey")).alias("farm_ref"))


@query(
    "audit_hashes",
    "SELECT a.conv_id, a.turn, sha256(a.text) AS prompt_hash, sha256(b.text) AS response_hash FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'",
)
def audit_hashes(spark, d):
    """User turns with the answer that follows, appended to a JSON-lines log as hashes and read back."""
    from ..plans.frames import staging_path
    from ..sources.tables import append_log

    turns = table(spark, d, "conversations")
    answers = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    calls = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt")).join(answers, ["conv_id", "turn"])
    path = staging_path(spark, "audit")
    append_log(gv.audit_rows(calls, ["conv_id", "turn"], "prompt", "response"), path)
    return spark.read.schema("conv_id BIGINT, turn BIGINT, prompt_hash STRING, response_hash STRING").json(path)


_KIND = "CASE l_orderkey % 4 WHEN 0 THEN 'raw_sensor' WHEN 1 THEN 'llm_context' WHEN 2 THEN 'dashboard' ELSE 'personal_info' END"
_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def payloads(spark, d):
    cents = lambda e: f"CAST(CAST(floor({e}) AS BIGINT) AS STRING)"
    return table(spark, d, "lineitem").selectExpr(
        *_ID, f"{_KIND} AS request_type",
        f"map('water_temp', {cents('l_quantity')}, 'din', {cents('l_extendedprice')}, 'owner_name', l_returnflag, 'battery', l_linestatus, 'depth', {cents('l_tax * 100')}, 'salinity', CASE WHEN l_linenumber = 1 THEN NULL ELSE {cents('l_discount * 100 + 0.5')} END) AS payload",
        "map('anomaly_score', CAST(l_linenumber AS STRING), 'stage', l_linestatus, 'owner_email', 'x') AS prediction",
    )


@query(
    "policy_filter",
    f"""WITH k AS (SELECT {', '.join(_ID)}, {_KIND} AS t FROM lineitem) SELECT {', '.join(_ID)}, CASE WHEN t IN ('raw_sensor', 'personal_info') THEN 'block' ELSE 'filtered' END AS action,
    CASE t WHEN 'llm_context' THEN 'owner_name,battery,depth' WHEN 'dashboard' THEN 'owner_name' ELSE '' END AS removed, CASE t WHEN 'llm_context' THEN 'water_temp,din,salinity' WHEN 'dashboard' THEN 'water_temp,din,battery,depth,salinity' END AS kept_keys,
    CASE t WHEN 'llm_context' THEN 'medium' WHEN 'dashboard' THEN 'low' ELSE 'high' END AS risk_level FROM k""",
)
def policy_filter(spark, d):
    p = gv.policy_evaluate(payloads(spark, d))
    return p.select(*_ID, "action", F.array_join("removed", ",").alias("removed"), F.array_join(F.map_keys("kept"), ",").alias("kept_keys"), "risk_level")


@query(
    "llm_context",
    f"""SELECT {', '.join(_ID)}, 'FARM_' || upper(substr(sha256(CAST(l_suppkey AS VARCHAR)), 1, 8)) AS farm_ref, 'water_temp=' || CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) || ', din=' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)
    || CASE WHEN l_linenumber = 1 THEN '' ELSE ', salinity=' || CAST(CAST(floor(l_discount * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS VARCHAR) END AS sensor_summary, '황백화지수=' || CAST(l_linenumber AS VARCHAR) || ', 단계=' || l_linestatus AS prediction_summary FROM lineitem""",
)
def llm_context(spark, d):
    c = gv.context_record(payloads(spark, d), "l_suppkey", "payload", "prediction")
    return c.select(*_ID, "farm_ref", "sensor_summary", "prediction_summary")
