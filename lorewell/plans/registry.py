"""All queries over the given tables, with their SQL. How the tables stand for a corpus: source is the project, path is
source/doc_id.md, embeddings are joined by id, benchmark texts are the questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.functions import scalars as S
from lorewell.operators import catalog, corpus
from lorewell.operators.requests import accepted_once
from lorewell.sources.staging import shared_folder
from lorewell.sources.store import ChunkTable

_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(name: str, sql: str | None = None):
    def keep(f):
        _ALL[name] = (f, sql)
        return f

    return keep


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    d = _read(spark, sf, "documents")
    return d.select("doc_id", F.col("source").alias("project_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.col("lang").alias("language"), "text", S.content_hash(F.col("text")).alias("content_hash"))


DOCS = "docs AS (SELECT doc_id, source AS project_id, source || '/' || doc_id || '.md' AS file_path, lang AS language, text, sha256(text) AS content_hash FROM documents)"


def _scalar(name: str, tbl: str, key: str, made, sql: str, col: str = "value") -> None:
    _query(name, f"SELECT {key}, {sql} AS {col} FROM {tbl}")(lambda s, sf: _read(s, sf, tbl).select(key, made().alias(col)))


_unescaped = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
for _name, _value in S.ENTITIES.items():
    _unescaped = "replace({}, '{}', '{}')".format(_unescaped, _name, _value.replace("'", "''"))
_scalar("content_hash", "documents", "doc_id", lambda: S.content_hash(F.col("text")), "sha256(text)")
_scalar("estimate_tokens", "documents", "doc_id", lambda: S.estimate_tokens(F.col("text")).cast("long"), r"CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(len(regexp_extract_all(text, '[^\s\x{85}\x{A0}\p{Z}\x{0B}]+')) * 1.3::DOUBLE)) END AS BIGINT)")
_scalar("normalize_newlines", "documents", "doc_id", lambda: F.sha2(S.normalize_newlines(F.col("text")), 256), r"sha256(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n$', ''))")
_scalar("slugify_title", "benchmark", "item_id", lambda: S.slugify_title(F.col("text")), r"CASE WHEN rtrim(left(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 50), '-') = '' THEN 'untitled' ELSE rtrim(left(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 50), '-') END")
_scalar("html_title", "pages", "page_id", lambda: S.html_title(F.col("html")), rf"trim(regexp_replace({_unescaped}, '\s+', ' ', 'g'))")
_scalar("title_from_url", "pages", "page_id", lambda: S.title_from_url(F.col("url")), r"CASE WHEN regexp_replace(regexp_extract(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1), '\.[^.]*$', '') <> '' THEN regexp_replace(regexp_extract(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1), '\.[^.]*$', '') ELSE regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1) END")
_scalar("redact_credentials", "documents", "doc_id", lambda: F.sha2(S.redact_credentials(F.col("text")), 256), r"sha256(regexp_replace(regexp_replace(text, '://([^:/\s@]+):([^@/\s]+)@', '://\1:******@', 'g'), '(?i)(password|passwd|pwd|secret|token|api_?key)\s*([=:])\s*([^;\s&]+)', '\1\2******', 'g'))")
_scalar("query_terms", "benchmark", "item_id", lambda: F.array_join(S.query_terms(F.col("text")), " "), "array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+'), ' ')")
_KINDS = ["text/html; charset=utf-8", "Application/JSON", "image/png", "text/x-anything", "application/pdf", " application/xml "]
_scalar("content_type_supported", "pages", "page_id", lambda: S.content_type_supported(F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("page_id") % 6 + 1).cast("int"))), "page_id % 6 NOT IN (2, 4)")


@_query("detect_language", f"WITH {DOCS} SELECT doc_id, 'markdown' AS value FROM docs")
def _(s, sf):
    return documents(s, sf).select("doc_id", S.detect_language(F.col("file_path")).alias("value"))


@_query("should_index", f"WITH {DOCS} SELECT doc_id FROM docs WHERE octet_length(encode(text)) <= 1048576")
def _(s, sf):
    return documents(s, sf).filter(S.should_index(F.col("file_path"), F.octet_length("text"))).select("doc_id")


@_query("non_blank", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\S')")
def _(s, sf):
    return _read(s, sf, "documents").filter(S.non_blank(F.col("text"))).select("doc_id")


@_query("document_search", f"WITH {DOCS} SELECT doc_id, file_path FROM docs WHERE contains(lower(file_path), 'src1') AND language = 'en'")
def _(s, sf):
    return documents(s, sf).filter(F.lower("file_path").contains("src1") & (F.col("language") == "en")).select("doc_id", "file_path")


@_query("distinct_languages", "SELECT DISTINCT coalesce(nullif(lang, ''), 'unknown') AS language FROM documents")
def _(s, sf):
    return _read(s, sf, "documents").select(F.coalesce(F.nullif("lang", F.lit("")), F.lit("unknown")).alias("language")).distinct()


@_query("list_with_total", "SELECT doc_id, source, CAST(count(*) OVER (PARTITION BY source) AS BIGINT) AS total FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) BETWEEN 21 AND 40")
def _(s, sf):
    d = _read(s, sf, "documents").select("doc_id", "source")
    totals = d.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("total"))
    page = d.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("n <= 40").filter("n >= 21")
    return page.join(totals, F.col("source").eqNullSafe(F.col("of"))).drop("n", "of")


@_query("conversation_with_messages", "SELECT conv_id, CAST(count(*) AS BIGINT) AS messages, sha256(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS said FROM conversations GROUP BY conv_id")
def _(s, sf):
    c = _read(s, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return c.select("conv_id", "messages", F.sha2(F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n"), 256).alias("said"))


@_query("conversation_title", "SELECT conv_id, left(trim(arg_min(text, turn)), 40) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id")
def _(s, sf):
    return _read(s, sf, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.left(F.trim(F.min_by("text", "turn")), F.lit(40)).alias("title"))


def _snapshots(s, sf):
    d = documents(s, sf)
    old = d.filter("doc_id % 10 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("content_hash")))
    return old, d.filter("doc_id % 11 <> 0")


DIFF = f"""WITH {DOCS}, e AS (SELECT project_id, file_path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE content_hash END AS h FROM docs WHERE doc_id % 10 <> 0),
n AS (SELECT project_id, file_path, content_hash AS h FROM docs WHERE doc_id % 11 <> 0),
diff AS (SELECT coalesce(e.project_id, n.project_id) AS project_id, coalesce(e.file_path, n.file_path) AS file_path,
  CASE WHEN e.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' WHEN e.h <> n.h THEN 'modified' ELSE 'unchanged' END AS change
  FROM e FULL JOIN n ON e.project_id = n.project_id AND e.file_path = n.file_path)"""


@_query("sync_diff", f"{DIFF} SELECT project_id, file_path, change FROM diff")
def _(s, sf):
    return corpus.sync_diff(*_snapshots(s, sf)).select("project_id", "file_path", "change")


@_query("changed_files", f"{DIFF} SELECT project_id, file_path FROM diff WHERE change IN ('added', 'modified')")
def _(s, sf):
    return corpus.sync_diff(*_snapshots(s, sf)).filter(F.col("change").isin("added", "modified")).select("project_id", "file_path")


@_query("deleted_documents", f"{DIFF} SELECT project_id, file_path FROM diff WHERE change = 'deleted'")
def _(s, sf):
    old, new = _snapshots(s, sf)
    return corpus.delete_rows(old, new, ["project_id", "file_path"]).select("project_id", "file_path")


@_query("pipeline_metrics", f"{DIFF} SELECT project_id, change, CAST(count(*) AS BIGINT) AS files FROM diff GROUP BY project_id, change")
def _(s, sf):
    return corpus.sync_diff(*_snapshots(s, sf)).groupBy("project_id", "change").agg(F.count("*").alias("files"))


@_query("upsert_documents", f"WITH {DOCS} SELECT project_id, file_path, CASE WHEN doc_id % 10 = 0 OR doc_id % 11 <> 0 THEN content_hash WHEN doc_id % 7 = 0 THEN 'old' ELSE content_hash END AS content_hash FROM docs WHERE NOT (doc_id % 10 = 0 AND doc_id % 11 = 0)")
def _(s, sf):
    old, new = (x.select("project_id", "file_path", "content_hash") for x in _snapshots(s, sf))
    return corpus.upsert(old, new, ["project_id", "file_path"], ["content_hash"])


@_query("dedup_embeddings", f"WITH {DOCS}, c AS (SELECT DISTINCT project_id, content_hash FROM docs WHERE doc_id % 2 = 0) SELECT doc_id, c.content_hash IS NOT NULL AS cached FROM docs LEFT JOIN c USING (project_id, content_hash)")
def _(s, sf):
    d = documents(s, sf)
    return corpus.dedup_embeddings(d, d.filter("doc_id % 2 = 0")).select("doc_id", "cached")


@_query("embeddings_saved", f"WITH {DOCS}, c AS (SELECT DISTINCT project_id, content_hash FROM docs WHERE doc_id % 2 = 0) SELECT project_id, CAST(count(c.content_hash) AS BIGINT) AS saved FROM docs LEFT JOIN c USING (project_id, content_hash) GROUP BY project_id")
def _(s, sf):
    d = documents(s, sf)
    return corpus.dedup_embeddings(d, d.filter("doc_id % 2 = 0")).groupBy("project_id").agg(F.count_if("cached").alias("saved"))


@_query("delete_project", "SELECT doc_id FROM documents WHERE source <> 'src3'")
def _(s, sf):
    return _read(s, sf, "documents").filter("source <> 'src3'").select("doc_id")


@_query("delete_conversation_cascade", "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def _(s, sf):
    c = _read(s, sf, "conversations")
    return corpus.delete_rows(c, c.filter("role = 'system'"), ["conv_id"]).select("conv_id", "turn")


@_query("job_state_stream", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def _(s, sf):
    return _read(s, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


#: The whole chunker as relations: lines, prefix sums, ends, overlaps and a recursive walk.
CHUNKS = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n$', '') AS text FROM documents WHERE regexp_matches(text, '\S')),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM t),
k AS (SELECT doc_id, i, line, CASE WHEN length(line) = 0 THEN 0 ELSE greatest(1, CAST(floor(len(regexp_extract_all(line, '[^\s\x{85}\x{A0}\p{Z}\x{0B}]+')) * 1.3::DOUBLE) AS INT)) END AS raw,
  regexp_matches(line, '^[\s\x{85}\x{A0}\p{Z}\x{0B}]*(func |def |class |#|$)') AS edge FROM l),
p AS (SELECT doc_id, i, edge, sum(greatest(raw, 1)) OVER w - greatest(raw, 1) AS p0, sum(greatest(raw, 1)) OVER w AS p1, sum(raw) OVER w - raw AS r0, count(*) OVER (PARTITION BY doc_id) AS n FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
pts AS (SELECT doc_id, i, edge, p0, p1, r0, n FROM p UNION ALL SELECT doc_id, i + 1, false, p1, p1, r0 + (SELECT raw FROM k WHERE k.doc_id = p.doc_id AND k.i = p.i), n FROM p WHERE i = n - 1),
e AS (SELECT a.doc_id, a.i, a.n, min(b.i) AS e FROM p a JOIN pts b ON a.doc_id = b.doc_id AND b.i > a.i AND b.i <= least(a.i + 100, a.n)
  WHERE b.i = least(a.i + 100, a.n) OR (b.p1 - a.p0 > 384 AND (b.i - a.i >= 5 OR b.p0 - a.p0 >= 768) AND (b.edge OR b.p0 - a.p0 >= 768)) GROUP BY a.doc_id, a.i, a.n),
o AS (SELECT e.doc_id, e.i, e.n, e.e, CASE WHEN e.e >= e.n THEN e.n ELSE greatest(e.i + 1, e.e - count(j.i)) END AS nxt FROM e JOIN pts x ON x.doc_id = e.doc_id AND x.i = e.e
  LEFT JOIN p j ON j.doc_id = e.doc_id AND j.i >= e.i AND j.i < e.e AND x.r0 - j.r0 <= 40 GROUP BY e.doc_id, e.i, e.n, e.e),
walk AS (SELECT doc_id, i, e, n, nxt, 0 AS chunk_index FROM o WHERE i = 0 UNION ALL SELECT o.doc_id, o.i, o.e, o.n, o.nxt, walk.chunk_index + 1 FROM walk JOIN o ON o.doc_id = walk.doc_id AND o.i = walk.nxt)
SELECT doc_id, chunk_index, CAST(i + 1 AS INT) AS start_line, CAST(e AS INT) AS end_line FROM walk
"""


@_query("chunk_documents", CHUNKS)
def _(s, sf):
    return corpus.chunk_documents(_read(s, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("language"))).select(F.col("id").alias("doc_id"), "chunk_index", "start_line", "end_line")


def chunked(s: SparkSession, docs: DataFrame) -> DataFrame:
    """Chunks of docs(id, text, language) from this application's table of chunks, which is filled with what it lacks."""
    made = ChunkTable(s, f"{shared_folder(s)}/lorewell-chunks-{s.sparkContext.applicationId}")
    made.fill(docs)
    return made.of(docs)


def _retrieval(s, sf):
    d = documents(s, sf).join(_read(s, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id").withColumnRenamed("doc_id", "id").withColumnRenamed("text", "content")
    q = _read(s, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    q = q.join(d.select(F.col("id").alias("query_id"), "project_id", F.col("vector").alias("query_vector")), "query_id")
    return q, d


SIMS = f"""WITH {DOCS}, d AS (SELECT docs.doc_id AS id, project_id, file_path, text AS content, embedding AS vector FROM docs JOIN embeddings ON vec_id = doc_id),
q AS (SELECT item_id AS query_id, trim(benchmark.text) AS query, d.project_id, d.vector AS qv FROM benchmark JOIN d ON d.id = item_id),
sims AS (SELECT query_id, query, d.id, d.content, d.file_path, list_cosine_similarity(CAST(d.vector AS DOUBLE[]), CAST(q.qv AS DOUBLE[])) AS sim FROM q JOIN d ON d.project_id = q.project_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM sims)"""


def fused_sql(pool: int = 20, least: float = -2.0, keep: str = "true") -> str:
    """The rest of hybrid retrieval after the relation ranked, down to best(query_id, id, rank, sim, lexical, score, place)."""
    return rf"""pool AS (SELECT * FROM ranked WHERE rank <= {pool} AND sim >= {least}),
terms AS (SELECT query_id, id, unnest(regexp_extract_all(lower(query), '[a-z0-9_]+')) AS t, len(regexp_extract_all(lower(query), '[a-z0-9_]+')) AS nt, lower(content) AS c, lower(file_path) AS f FROM pool),
hits AS (SELECT query_id, id, nt, t, length(t) >= 2 AS use, (length(c) - length(replace(c, t, ''))) / length(t) AS n, contains(f, t) AS inpath FROM terms),
lex AS (SELECT query_id, id, sum(CASE WHEN use AND n > 0 THEN n / (n + 2.0::DOUBLE) ELSE 0 END) + sum(CASE WHEN use AND inpath THEN 1.5 ELSE 0 END)
  + CASE WHEN count_if(use AND n > 0) > 0 THEN 3.0::DOUBLE * count_if(use AND n > 0) / max(nt) ELSE 0 END AS s FROM hits GROUP BY query_id, id),
scored AS (SELECT pool.query_id, pool.id, pool.rank, pool.sim, pool.file_path, coalesce(s, 0) + CASE WHEN length(query) > 3 AND contains(lower(content), lower(query)) THEN 10 ELSE 0 END AS lexical FROM pool LEFT JOIN lex USING (query_id, id)),
lr AS (SELECT *, CASE WHEN lexical > 0 THEN row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 9) DESC, rank) END AS lrank FROM scored),
fused AS (SELECT *, 1.0::DOUBLE / (60 + rank) + coalesce(1.0::DOUBLE / (60 + lrank), 0) AS score FROM lr),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sim DESC, id) AS place FROM fused WHERE {keep})"""


@_query("vector_topk", f"{SIMS} SELECT query_id, id, CAST(rank AS INT) AS rank, round(sim, 6) AS similarity FROM ranked WHERE rank <= 5")
def _(s, sf):
    return corpus.vector_topk(*_retrieval(s, sf)).select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"))


@_query("candidate_pool", f"{SIMS} SELECT query_id, CAST(count_if(rank <= 20) AS BIGINT) AS pool_of_5, CAST(count_if(rank <= 32) AS BIGINT) AS pool_of_8 FROM ranked GROUP BY query_id")
def _(s, sf):
    n = corpus.candidate_pool
    found = corpus.vector_topk(*_retrieval(s, sf), k=n(8)).groupBy("query_id")
    return found.agg(F.count_if(F.col("rank") <= n(5)).alias("pool_of_5"), F.count_if(F.col("rank") <= n(8)).alias("pool_of_8"))


@_query("rrf_merge", f"{SIMS}, {fused_sql()} SELECT query_id, id, file_path, round(score, 6) AS score, round(sim, 6) AS similarity FROM fused")
def _(s, sf):
    q, d = _retrieval(s, sf)
    got = corpus.rrf(corpus.rankings_union(corpus.scored_pool(corpus.vector_topk(q.withColumn("query", F.trim("query")), d, corpus.candidate_pool(5)))))
    return got.select("query_id", F.col("key").alias("id"), "file_path", F.round("score", 6).alias("score"), F.round("similarity", 6).alias("similarity"))


HYBRID = f"{SIMS}, {fused_sql()}"


@_query("hybrid_retrieve", f"{HYBRID} SELECT query_id, id, CAST(place AS INT) AS place, round(score, 6) AS score, round(sim, 6) AS similarity FROM best WHERE place <= 5")
def _(s, sf):
    return corpus.hybrid_retrieve(*_retrieval(s, sf)).select("query_id", "id", "place", F.round("score", 6).alias("score"), F.round("similarity", 6).alias("similarity"))


@_query("row_batch_documents", """WITH r AS (SELECT *, (row_number() OVER (ORDER BY c_custkey) - 1) // 1000 + 1 AS n FROM customer),
b AS (SELECT n, count(*) AS c, string_agg('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}', chr(10) ORDER BY c_custkey) AS body FROM r GROUP BY n)
SELECT 'data/public/customer_batch_' || n || '.jsonl' AS path, sha256('-- Database Records: public.customer (Batch ' || n || ')' || chr(10) || '-- Database: shop | Engine: postgres | Total Records: ' || c || chr(10) || chr(10) || body || chr(10)) AS content_hash FROM b""")
def _(s, sf):
    c = _read(s, sf, "customer").select("c_custkey", "c_mktsegment", "c_name", "c_nationkey")
    return catalog.row_batch_documents(c, "c_custkey", "public", "customer", "shop", "postgres").select("path", "content_hash")


#: The lock of a sync request, in microseconds.
LOCK = 300_000_000
TAKEN = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT *, t AS last, true AS accepted FROM e WHERE n = 1
  UNION ALL SELECT e.*, CASE WHEN e.t - w.last >= {LOCK} THEN e.t ELSE w.last END, e.t - w.last >= {LOCK} FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.n = w.n + 1)
"""


@_query("dedup_sync_requests", f"{TAKEN} SELECT event_id, accepted FROM w")
def _(s, sf):
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    e = _read(s, sf, "events").select(F.col("event_id").alias("id"), F.struct("user_id", "event_type").alias("key"), at)
    return accepted_once(e, LOCK).withColumnRenamed("id", "event_id")


@_query("dedup_sync_requests_by_type", TAKEN.replace("user_id, event_type ORDER", "event_type ORDER").replace("e.user_id = w.user_id AND ", "") + " SELECT event_id, accepted FROM w")
def _(s, sf):
    """The same with few hot keys, whose requests chain."""
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    return accepted_once(_read(s, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("key"), at), LOCK).withColumnRenamed("id", "event_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
