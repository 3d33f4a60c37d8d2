"""Queries from retrieval to prompts, and over chunk tables, with their SQL."""

from __future__ import annotations

import secrets

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.functions import scalars as S
from lorewell.operators import answers, corpus, vectors
from lorewell.plans.registry import CHUNKS, DOCS, SIMS, _query, _read, _retrieval, _scalar, chunked, documents, fused_sql


def _chunk_table(s, sf):
    """Chunks with their path, language, project and vector. A chunk has the given vector of its document, and its key as id."""
    d = documents(s, sf).join(_read(s, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id")
    found = chunked(s, d.select(F.col("doc_id").alias("id"), "text", "language")).withColumnRenamed("id", "doc_id")
    none = F.lit(None).cast("string")
    key = S.chunk_key(none, F.col("file_path"), F.col("start_line"), F.col("end_line"), none, none)
    kept = d.select("doc_id", "project_id", "file_path", "language", "vector")
    return found.join(kept, "doc_id").withColumn("id", key)


def _matches(s, sf, **how):
    q, _ = _retrieval(s, sf)
    hit = corpus.hybrid_retrieve(q, _chunk_table(s, sf), **how)
    return q, hit.select("query_id", "place", F.col("project_id").alias("source_id"), F.col("doc_id").alias("document_id"), "id", "file_path", "language", "start_line", "end_line", "similarity", "score", "content", F.col("token_count").cast("long").alias("token_count"))


TOKENS = r"CAST(CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, floor(len(regexp_extract_all(content, '[^\s\x{85}\x{A0}\p{Z}\x{0B}]+')) * 1.3::DOUBLE)) END AS BIGINT)"
CHUNK_SIMS = rf"""WITH ch AS ({CHUNKS}), {DOCS},
parts AS (SELECT doc_id, string_split(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n$', ''), chr(10)) AS lines FROM documents),
d AS (SELECT file_path || ':' || start_line || ':' || end_line AS id, ch.doc_id, project_id, file_path, language, start_line, end_line, array_to_string(lines[start_line:end_line], chr(10)) AS content, embedding AS vector
  FROM ch JOIN docs ON docs.doc_id = ch.doc_id JOIN parts ON parts.doc_id = ch.doc_id JOIN embeddings ON vec_id = ch.doc_id),
q AS (SELECT item_id AS query_id, trim(benchmark.text) AS query, project_id, embedding AS qv FROM benchmark JOIN docs ON docs.doc_id = item_id JOIN embeddings ON vec_id = item_id),
{SIMS[SIMS.index("sims AS ("):]}"""


def hits_sql(k: int = 5, **how) -> str:
    return f"""{CHUNK_SIMS}, {fused_sql(**how)},
hit AS (SELECT best.query_id, place, score, sim, d.* FROM best JOIN d ON d.id = best.id WHERE place <= {k})"""


HITS = hits_sql()
BLOCKS = f"""{HITS}, ctx AS (SELECT query_id, 'Context references:' || chr(10) || chr(10) || string_agg('[' || place || '] Source: ' || file_path || ' (lines ' || start_line || '-' || end_line || ')' || chr(10) || '```' || language || chr(10) || content
  || CASE WHEN ends_with(content, chr(10)) THEN '' ELSE chr(10) END || '```', chr(10) || chr(10) ORDER BY place) AS context FROM hit GROUP BY query_id)"""
ODD = r"regexp_matches(file_path, '[13579]\.md$')"
FOUND = "SELECT query_id, id, CAST(place AS INT) AS place, start_line, end_line, round(score, 6) AS score, round(sim, 6) AS similarity FROM hit"


def _found(hit):
    return hit.select("query_id", "id", "place", "start_line", "end_line", F.round("score", 6).alias("score"), F.round("similarity", 6).alias("similarity"))


@_query("chunk_retrieve", f"{HITS} {FOUND}")
def _(s, sf):
    return _found(_matches(s, sf)[1])


@_query("chunk_retrieve_filtered", f"{hits_sql(k=8, pool=32, least=0.05, keep=ODD)} {FOUND}")
def _(s, sf):
    return _found(_matches(s, sf, k=8, least=0.05, filters=["*1.md", "*3.md", "*5.md", "*7.md", "*9.md"])[1])


EACH = hits_sql(k="(3 + query_id % 4)", pool="greatest(4 * (3 + query_id % 4), 20)", least="CASE WHEN query_id % 3 = 0 THEN -2.0 ELSE 0.05 * (query_id % 3) END", keep=f"(query_id % 5 = 0 OR {ODD})").replace("place <= (3 + query_id", "place <= (3 + best.query_id")


@_query("chunk_retrieve_each", f"{EACH} {FOUND}")
def _(s, sf):
    n = F.col("query_id")
    asked = _retrieval(s, sf)[0].withColumn("top_k", 3 + n % 4).withColumn("similarity_min", F.when(n % 3 > 0, 0.05 * (n % 3)))
    asked = asked.withColumn("file_filters", F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("*[13579].md"))))
    return _found(corpus.retrieve_each(asked, _chunk_table(s, sf)))


@_query("chunk_text_sql", rf"{CHUNK_SIMS[: CHUNK_SIMS.index(chr(10) + 'q AS (SELECT')].rstrip().rstrip(',')} SELECT doc_id, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, sha256(content) AS content_hash, {TOKENS} AS token_count FROM d")
def _(s, sf):
    corpus.register_chunk_text(s)
    given = documents(s, sf).join(_read(s, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
    return s.sql("SELECT d.doc_id, c.start_line, c.end_line, c.content_hash, CAST(c.token_count AS BIGINT) AS token_count FROM {docs} d, LATERAL chunk_text(d.text, d.language) c", docs=given)


@_query("extract_citations", f"{HITS} SELECT query_id, CAST(place AS INT) AS number, project_id AS source_id, file_path, start_line, end_line, round(sim, 6) AS similarity, sha256(content) AS snippet FROM hit")
def _(s, sf):
    return answers.extract_citations(_matches(s, sf)[1]).select("query_id", "number", "source_id", "file_path", "start_line", "end_line", F.round("similarity", 6).alias("similarity"), F.sha2("snippet", 256).alias("snippet"))


@_query("context_prompt", f"{BLOCKS} SELECT query_id, sha256(context) AS context FROM ctx")
def _(s, sf):
    return answers.context_prompts(_matches(s, sf)[1]).select("query_id", F.sha2("context", 256).alias("context"))


@_query("rag_dataset", f"{BLOCKS} SELECT q.query_id, sha256('{answers.INSTRUCTIONS.replace(chr(39), chr(39) * 2).strip()}' || chr(10) || chr(10) || context || chr(10) || chr(10)) AS system, benchmark.text AS question FROM q JOIN ctx ON ctx.query_id = q.query_id JOIN benchmark ON item_id = q.query_id")
def _(s, sf):
    m = F.col("messages")
    return answers.rag_dataset(*_matches(s, sf)).select("query_id", F.sha2(m[0]["content"], 256).alias("system"), m[1]["content"].alias("question"))


@_query("context_budget", f"{HITS} SELECT query_id, CAST(place AS INT) AS place, CAST(so_far AS BIGINT) AS tokens_so_far FROM (SELECT *, sum({TOKENS}) OVER (PARTITION BY query_id ORDER BY place) AS so_far FROM hit) WHERE so_far <= 1000")
def _(s, sf):
    return answers.context_budget(_matches(s, sf)[1], 1000).select("query_id", "place", "tokens_so_far")


@_query("low_confidence", f"{HITS} SELECT query_id, round(max(sim), 6) AS best, max(sim) < 0.5 AS low FROM hit GROUP BY query_id")
def _(s, sf):
    return answers.low_confidence(_matches(s, sf)[1])


@_query("citation_check", f"{HITS} SELECT query_id, CASE WHEN count_if(place = 2) > 0 THEN '1,2' ELSE '1' END AS cited, CASE WHEN count_if(place = 2) > 0 THEN '9' ELSE '2,9' END AS stray, CASE WHEN count_if(place = 2) > 0 THEN 'See [1], [^2] and .' ELSE 'See [1],  and .' END AS stripped FROM hit GROUP BY query_id")
def _(s, sf):
    asked, hit = _matches(s, sf)
    told = answers.generate(answers.rag_dataset(asked, hit), lambda system, user: "See [1], [^2] and [9].")
    out = answers.citation_check(told, answers.extract_citations(hit))
    return out.select("query_id", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"), F.array_join(F.col("stray").cast("array<string>"), ",").alias("stray"), "stripped")


def _evaluated(s, sf):
    q, d = _retrieval(s, sf)
    label = _read(s, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    known = d.select("id", "project_id").join(label, "id")
    asked = q.select("query_id", "project_id").join(label.select(F.col("id").alias("query_id"), "label"), "query_id")
    return answers.evaluate(corpus.vector_topk(q, d, 10).select("query_id", "id", "rank"), asked.join(known, ["project_id", "label"]).select("query_id", "id"), 10)


EVAL = f"""{SIMS}, rel AS (SELECT q.query_id, d.id FROM q JOIN embeddings a ON a.vec_id = q.query_id JOIN d ON d.project_id = q.project_id JOIN embeddings b ON b.vec_id = d.id AND b.label = a.label),
h AS (SELECT r.query_id, count(*) AS hits, min(rank) AS first FROM ranked r JOIN rel ON rel.query_id = r.query_id AND rel.id = r.id WHERE rank <= 10 GROUP BY r.query_id),
w AS (SELECT query_id, count(*) AS wanted FROM rel GROUP BY query_id), ev AS (SELECT w.query_id, coalesce(hits, 0)::DOUBLE AS hits, wanted, first FROM w LEFT JOIN h ON h.query_id = w.query_id)"""


for _name, _col, _sql in [("eval_recall_at_k", "recall", "hits / wanted"), ("eval_precision", "precision", "hits / 10"), ("eval_mrr", "mrr", "coalesce(1.0::DOUBLE / first, 0)")]:
    _query(_name, f'{EVAL} SELECT query_id, round({_sql}, 6) AS "{_col}" FROM ev')(lambda s, sf, c=_col: _evaluated(s, sf).select("query_id", F.round(c, 6).alias(c)))


@_query("similarity_join", f"{SIMS} SELECT query_id, id, round(sim, 6) AS similarity FROM sims")
def _(s, sf):
    return corpus.similarities(*_retrieval(s, sf), ["project_id"]).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@_query("file_filter", rf"WITH {DOCS} SELECT doc_id FROM docs WHERE regexp_matches(file_path, '^[^/]*/[^/]*7\.md$') OR starts_with(file_path, 'src1') OR starts_with(file_path, 'src2/1.md')")
def _(s, sf):
    return documents(s, sf).filter(S.file_filter(F.col("file_path"), ["*7.md", "src1/", "src2/1.md"]) & (F.col("file_path") != "")).select("doc_id")


def _chunks(s, sf):
    return chunked(s, _read(s, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("language"))).withColumnRenamed("id", "doc_id")


CH = f"WITH ch AS ({CHUNKS})"


@_query("document_chunk_counts", f"{CH} SELECT doc_id, CAST(count(*) AS BIGINT) AS total_chunks FROM ch GROUP BY doc_id")
def _(s, sf):
    return _chunks(s, sf).groupBy("doc_id").agg(F.count("*").alias("total_chunks"))


@_query("count_project_chunks", f"{CH} SELECT source AS project_id, CAST(count(*) AS BIGINT) AS chunks FROM ch JOIN documents USING (doc_id) GROUP BY source")
def _(s, sf):
    return _chunks(s, sf).join(_read(s, sf, "documents").select("doc_id", F.col("source").alias("project_id")), "doc_id").groupBy("project_id").agg(F.count("*").alias("chunks"))


@_query("project_totals", f"{CH}, n AS (SELECT doc_id, count(*) AS n FROM ch GROUP BY doc_id) SELECT source, CAST(count(*) AS BIGINT) AS documents, CAST(sum(coalesce(n, 1)) AS BIGINT) AS chunks FROM documents LEFT JOIN n USING (doc_id) GROUP BY ROLLUP(source)")
def _(s, sf):
    n = _chunks(s, sf).groupBy("doc_id").agg(F.count("*").alias("n"))
    met = _read(s, sf, "documents").select("doc_id", "source").join(n, "doc_id", "left")
    return met.rollup("source").agg(F.count("*").alias("documents"), F.sum(F.coalesce("n", F.lit(1))).alias("chunks"))


@_query("chunks_with_documents", f"{CH} SELECT doc_id, chunk_index, source || '/' || doc_id || '.md' AS file_path, lang AS language FROM ch JOIN documents USING (doc_id)")
def _(s, sf):
    return _chunks(s, sf).join(documents(s, sf).select("doc_id", "file_path", "language"), "doc_id").select("doc_id", "chunk_index", "file_path", "language")


@_query("document_with_chunks", f"{CH} SELECT doc_id, string_agg(start_line || '-' || end_line, ',' ORDER BY chunk_index) AS spans FROM ch GROUP BY doc_id")
def _(s, sf):
    spans = F.array_sort(F.collect_list(F.struct("chunk_index", F.concat_ws("-", "start_line", "end_line").alias("span"))))
    return _chunks(s, sf).groupBy("doc_id").agg(F.array_join(F.transform(spans, lambda x: x["span"]), ",").alias("spans"))


@_query("upsert_chunks", f"{CH} SELECT doc_id, chunk_index, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM ch WHERE doc_id % 3 = 0 OR chunk_index < 2")
def _(s, sf):
    c = _chunks(s, sf).select("doc_id", "chunk_index")
    old, new = c.filter("chunk_index < 2").withColumn("state", F.lit("old")), c.filter("doc_id % 3 = 0").withColumn("state", F.lit("new"))
    return corpus.upsert(old, new, ["doc_id", "chunk_index"], ["state"])


@_query("replace_document_chunks", f"{CH} SELECT doc_id, chunk_index, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM ch WHERE doc_id % 3 <> 0 OR chunk_index < 2")
def _(s, sf):
    old = _chunks(s, sf).select("doc_id", "chunk_index", F.lit("old").alias("state"))
    new = old.filter("doc_id % 3 = 0 and chunk_index < 2").withColumn("state", F.lit("new"))
    return corpus.delete_rows(old, new, ["doc_id"]).unionByName(new)


@_query("delete_document_chunks", f"{CH} SELECT doc_id, chunk_index FROM ch WHERE doc_id % 5 <> 0")
def _(s, sf):
    gone = _read(s, sf, "documents").filter("doc_id % 5 = 0").select("doc_id")
    return corpus.delete_rows(_chunks(s, sf), gone, ["doc_id"]).select("doc_id", "chunk_index")


@_query("delete_source_cascade", f"{CH} SELECT 'chunk' AS kind, doc_id, chunk_index FROM ch JOIN documents USING (doc_id) WHERE source <> 'src3' UNION ALL SELECT 'document', doc_id, -1 FROM documents WHERE source <> 'src3'")
def _(s, sf):
    docs = _read(s, sf, "documents").select("doc_id", "source")
    left = corpus.delete_cascade({"document": docs, "chunk": _chunks(s, sf)}, docs.filter("source = 'src3'").select("source"), [("document", ["source"]), ("chunk", ["doc_id"])])
    return left["chunk"].select(F.lit("chunk").alias("kind"), "doc_id", "chunk_index").unionByName(left["document"].select(F.lit("document").alias("kind"), "doc_id", F.lit(-1).alias("chunk_index")))


@_query("update_source_status", "SELECT source, CASE WHEN max(doc_id) % 2 = 0 THEN 'synced' ELSE 'idle' END AS status, CASE WHEN max(doc_id) % 4 = 0 THEN 'c2' ELSE 'c1' END AS last_commit FROM documents GROUP BY source")
def _(s, sf):
    have = _read(s, sf, "documents").groupBy("source").agg(F.max("doc_id").alias("top")).withColumn("status", F.lit("idle")).withColumn("last_commit", F.lit("c1"))
    new = have.filter("top % 2 = 0").select("source", F.lit("synced").alias("status"), F.when(F.col("top") % 4 == 0, "c2").otherwise("").alias("last_commit"), F.lit(None).cast("timestamp").alias("synced_at"))
    return corpus.update_source_status(have.withColumn("synced_at", F.lit(None).cast("timestamp")), new).select("source", "status", "last_commit")


@_query("append_message", "SELECT conv_id, CAST(count(*) + 1 AS BIGINT) AS messages, max(turn) + 1 AS last_turn FROM conversations GROUP BY conv_id")
def _(s, sf):
    c = _read(s, sf, "conversations").select("conv_id", "turn")
    more = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"))
    return c.unionByName(more).groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))


@_query("list_conversations", "SELECT conv_id, max(turn) AS last_turn, CAST(row_number() OVER (ORDER BY max(turn) DESC, conv_id) AS INT) AS place FROM conversations GROUP BY conv_id ORDER BY place LIMIT 20")
def _(s, sf):
    top = _read(s, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn")).orderBy(F.desc("last_turn"), "conv_id").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("last_turn"), "conv_id")))


@_query("list_documents", f"WITH {DOCS} SELECT doc_id, file_path FROM docs ORDER BY file_path, doc_id LIMIT 20 OFFSET 20")
def _(s, sf):
    return documents(s, sf).select("doc_id", "file_path").orderBy("file_path", "doc_id").offset(20).limit(20)


@_query("owner_scope", "SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents GROUP BY source HAVING min(doc_id) % 2 = 0)")
def _(s, sf):
    docs = _read(s, sf, "documents").select("doc_id", "source")
    own = docs.groupBy("source").agg(F.min("doc_id").alias("low")).filter("low % 2 = 0").select("source")
    return docs.join(own, "source", "left_semi").select("doc_id")


@_query("job_transitions", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event, CAST(count(*) AS BIGINT) AS steps, max(ts) AS finished_at FROM events GROUP BY user_id")
def _(s, sf):
    return _read(s, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"), F.count("*").alias("steps"), F.max("ts").alias("finished_at"))


_scalar("row_json", "customer", "c_custkey", lambda: F.to_json(F.struct("c_custkey", "c_mktsegment", "c_name", "c_nationkey"), {"ignoreNullFields": "false"}), "CAST(json_object('c_custkey', c_custkey, 'c_mktsegment', c_mktsegment, 'c_name', c_name, 'c_nationkey', c_nationkey) AS VARCHAR)")
_scalar("url_is_safe", "pages", "page_id", lambda: S.url_is_safe(F.col("url")), r"regexp_matches(lower(url), '^https?://[^/?#:]+') AND NOT regexp_matches(lower(url), '^https?://(localhost|[^/?#:]*\.(local|internal|localhost)|(10|127|0)\.[0-9.]+)([/?#:]|$)')")
_scalar("is_binary", "documents", "doc_id", lambda: S.is_binary(F.col("text")), "contains(left(text, 8000), chr(0))")
_FIRST = "trim(regexp_extract(text, '[^\\n]*\\S[^\\n]*'))"
_scalar("title_from_text", "benchmark", "item_id", lambda: S.title_from_text(F.col("text"), F.lit("https://a.example/x.md")), f"CASE WHEN {_FIRST} = '' THEN 'x' WHEN starts_with({_FIRST}, '# ') THEN trim(substr({_FIRST}, 3)) WHEN octet_length(encode({_FIRST})) > 80 THEN left({_FIRST}, list_max(list_filter(range(1, 81), lambda i: octet_length(encode(left({_FIRST}, i))) <= 80))) || '...' ELSE {_FIRST} END")
_scalar("markdown_cell", "documents", "doc_id", lambda: F.sha2(S.markdown_cell(F.col("text")), 256), "sha256(trim(regexp_replace(replace(text, '|', '\\|'), '\\r\\n|\\n|\\r', ' ', 'g')))")
_KEY = secrets.token_hex(16)
_scalar("encrypt_column", "pages", "page_id", lambda: S.decrypt_column(S.encrypt_column(F.col("url"), F.lit(_KEY)), F.lit(_KEY)), "url")
_scalar("repo_slug", "pages", "page_id", lambda: S.repo_slug(F.lit(""), F.regexp_extract("url", r"//([^?#]*)", 1)), r"nullif(regexp_extract(regexp_extract(url, '//([^?#]*)', 1), '^([^/\s]+/[^/\s#]+)$', 1), '')")


@_query("ann_topk")
def _(s, sf):
    q, d = _retrieval(s, sf)
    return vectors.ann_topk(q, d, vectors.fit_cells(d)).select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"))


@_query("embed_chunks")
def _(s, sf):
    return vectors.embed_chunks(_chunks(s, sf), vectors.hash_embedding).select("doc_id", "chunk_index", "content_hash", S.vector_literal(F.col("vector")).alias("vector"))


@_query("similarity_min", f"{SIMS} SELECT query_id, id, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 20 AND round(sim, 9) >= 0.2")
def _(s, sf):
    return corpus.vector_topk(*_retrieval(s, sf), k=20).filter(F.round("similarity", 9) >= 0.2).select("query_id", "id", "rank")


@_query("filtered_retrieve", f"{SIMS}, {fused_sql(keep=ODD)} SELECT query_id, id, CAST(place AS INT) AS place FROM best WHERE place <= 5")
def _(s, sf):
    return corpus.hybrid_retrieve(*_retrieval(s, sf), filters=["*1.md", "*3.md", "*5.md", "*7.md", "*9.md"]).select("query_id", "id", "place")


@_query("job_progress", "SELECT source, CAST(20 + floor(count_if(doc_id % 11 <> 0)::DOUBLE / count(*) * 75) AS INT) AS percent FROM documents GROUP BY source")
def _(s, sf):
    n = _read(s, sf, "documents").groupBy("source").agg(F.count_if(F.col("doc_id") % 11 != 0).alias("done"), F.count("*").alias("total"))
    return n.select("source", S.job_progress(F.col("done"), F.col("total")).alias("percent"))


@_query("answer_usage", f"SELECT conv_id, CAST(sum({TOKENS.replace('content', 'text')}) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS answers FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def _(s, sf):
    c = _read(s, sf, "conversations").filter("role = 'assistant'")
    return c.groupBy("conv_id").agg(F.sum(S.estimate_tokens(F.col("text"))).alias("tokens"), F.count("*").alias("answers"))


@_query("list_projects", "SELECT source, min(doc_id) AS created FROM documents GROUP BY source ORDER BY created DESC, source LIMIT 20")
def _(s, sf):
    return _read(s, sf, "documents").groupBy("source").agg(F.min("doc_id").alias("created")).orderBy(F.desc("created"), "source").limit(20)


@_query("list_sources", "SELECT source, min(doc_id) AS created FROM documents GROUP BY source")
def _(s, sf):
    return _read(s, sf, "documents").groupBy("source").agg(F.min("doc_id").alias("created")).orderBy("created", "source")


@_query("list_jobs", "SELECT user_id, max(ts) AS last_at FROM events GROUP BY user_id ORDER BY last_at DESC, user_id LIMIT 20")
def _(s, sf):
    return _read(s, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last_at")).orderBy(F.desc("last_at"), "user_id").limit(20)


@_query("project_search", "SELECT source, CAST(count(*) AS BIGINT) AS documents FROM documents WHERE contains(lower(source), 'c1') OR contains(lower(lang), 'c1') GROUP BY source")
def _(s, sf):
    met = F.lower("source").contains("c1") | F.lower("lang").contains("c1")
    return _read(s, sf, "documents").filter(met).groupBy("source").agg(F.count("*").alias("documents"))


@_query("chunk_key", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN source || ':1:' || (doc_id % 9 + 1) WHEN 2 THEN sha256(text) ELSE source END AS chunk_key FROM documents")
def _(s, sf):
    d, n = _read(s, sf, "documents"), F.col("doc_id") % 4
    line = lambda c: F.when(n == 1, c)
    key = S.chunk_key(F.when(n == 0, F.col("doc_id")), F.col("source"), line(F.lit(1)), line((F.col("doc_id") % 9 + 1).cast("int")), F.when(n == 2, S.content_hash(F.col("text"))), F.lit(None).cast("string"))
    return d.select("doc_id", key.alias("chunk_key"))


@_query("all_chunks", f"{CH} SELECT doc_id, chunk_index FROM ch")
def _(s, sf):
    d = _chunks(s, sf).join(_read(s, sf, "documents").select("doc_id", F.col("source").alias("project_id")), "doc_id")
    c = corpus.dedup_embeddings(d, d.filter("doc_id % 2 = 0"))
    return c.filter(~F.col("cached")).unionByName(c.filter("cached")).select("doc_id", "chunk_index")
