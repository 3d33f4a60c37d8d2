"""Queries over pages, requests and syncs, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.operators import corpus
from lorewell.operators import ingest as whole
from lorewell.operators.metrics import sync_metrics
from lorewell.operators.vectors import hash_embedding
from lorewell.plans.answers import CHUNK_SIMS, TOKENS, _chunk_table
from lorewell.plans.registry import DIFF, DOCS, _query, _read, _snapshots
from lorewell.sources import scans
from lorewell.streaming import jobs

PERIOD, BURST = 21_600_000_000, 3

BUCKET = f"""
WITH RECURSIVE e AS (SELECT event_id AS id, user_id AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT id, key, t, n, CAST({PERIOD * (BURST - 1)} AS BIGINT) AS level, true AS accepted, CAST(0 AS BIGINT) AS wait FROM e WHERE n = 1
  UNION ALL SELECT id, key, t, n, CAST(CASE WHEN x >= {PERIOD} THEN x - {PERIOD} ELSE x END AS BIGINT), x >= {PERIOD}, CAST(CASE WHEN x >= {PERIOD} THEN 0 ELSE greatest(1000, {PERIOD} - x) END AS BIGINT)
  FROM (SELECT e.id, e.key, e.t, e.n, least({PERIOD * BURST}, w.level + e.t - w.t) AS x FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1))
SELECT id, key, accepted, wait FROM w
"""


@_query("token_bucket", BUCKET)
def _(s, sf):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return jobs.token_bucket(_read(s, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), at.alias("at")), PERIOD, BURST)


JOB = """WITH e AS (SELECT user_id AS job_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'progress' END AS kind FROM events)
SELECT job_id, CASE arg_max(kind, (ts, event_id)) WHEN 'progress' THEN 'running' WHEN 'complete' THEN 'completed' ELSE 'failed' END AS status,
  CAST(arg_max(CASE WHEN kind = 'complete' THEN 100 ELSE event_id % 100 END, (ts, event_id)) FILTER (WHERE kind <> 'fail') AS INT) AS progress_percent,
  CAST(arg_max(event_id % 50, (ts, event_id)) FILTER (WHERE kind = 'progress') AS INT) AS processed_files, CAST(max(50) FILTER (WHERE kind = 'progress') AS INT) AS total_files,
  arg_max('e' || event_id, (ts, event_id)) FILTER (WHERE kind = 'fail') AS error_message, epoch_us(max(ts) FILTER (WHERE kind <> 'progress')) AS finished_at FROM e GROUP BY job_id"""


@_query("job_records", JOB)
def _(s, sf):
    kind = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").otherwise("progress")
    e = _read(s, sf, "events").select(F.col("user_id").alias("job_id"), "ts", "event_id", kind.alias("kind"), (F.col("event_id") % 100).alias("percent"), (F.col("event_id") % 50).alias("processed"), F.lit(50).alias("total"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"))
    return jobs.job_records(e).withColumn("finished_at", F.unix_micros("finished_at"))


@_query("push_events", "SELECT 'own/repo' || user_id AS repository, event_type AS branch, CAST(event_id AS VARCHAR) AS commit FROM events WHERE event_type <> 'error'")
def _(s, sf):
    e = _read(s, sf, "events")
    owner = F.struct(F.lit("own").alias("login"), F.lit("own").alias("name"))
    repo = F.struct(F.concat(F.lit("own/repo"), F.col("user_id").cast("string")).alias("full_name"), F.concat(F.lit("repo"), F.col("user_id").cast("string")).alias("name"), owner.alias("owner"))
    body = F.to_json(F.struct(F.concat(F.lit("refs/heads/"), F.col("event_type")).alias("ref"), F.col("event_id").cast("string").alias("after"), repo.alias("repository")))
    return jobs.push_events(e.select(F.when(F.col("event_type") == "error", "ping").otherwise("push").alias("event"), body.alias("body")))


@_query("scan_web_pages")
def _(s, sf):
    return scans.scan_web_pages(_read(s, sf, "pages"))


@_query("page_ingest")
def _(s, sf):
    pages = scans.scan_web_pages(_read(s, sf, "pages")).select(F.col("page_id").alias("id"), F.col("content").alias("text"), F.lit("markdown").alias("language"))
    return corpus.chunk_documents(pages).withColumnRenamed("id", "page_id")


@_query("ingest_sync", "SELECT source AS project_id, CAST(count(*) AS BIGINT) AS files FROM documents WHERE doc_id % 11 <> 0 AND (doc_id % 10 = 0 OR doc_id % 7 = 0) AND regexp_matches(text, '\\S') GROUP BY source")
def _(s, sf):
    _, chunks = jobs.ingest_sync(*_snapshots(s, sf))
    return chunks.select(F.substring_index("id", "/", 1).alias("project_id"), "id").distinct().groupBy("project_id").agg(F.count("*").alias("files"))


@_query("scan_corpus", "SELECT 'doc/' || doc_id AS path, sha256(text) AS content_hash FROM documents UNION ALL SELECT 'item/' || item_id, sha256(text) FROM benchmark")
def _(s, sf):
    part = lambda t, k, p: scans.scanned(_read(s, sf, t), F.concat(F.lit(p), F.col(k).cast("string")), F.lit("text"), F.col("text"))
    return scans.scan_corpus(part("documents", "doc_id", "doc/"), part("benchmark", "item_id", "item/")).select("path", "content_hash")


def _synced(s, sf):
    old, new = _snapshots(s, sf)
    old = old.select("project_id", "file_path", "language", "content_hash", F.lit(0).cast("long").alias("total_chunks"))
    none = s.createDataFrame([], "project_id string, file_path string, chunk_index int, start_line int, end_line int, content string, token_count int, content_hash string, vector array<float>")
    return whole.sync_corpus(old, none, new, hash_embedding)


@_query("sync_documents", f"WITH {DOCS} SELECT project_id, file_path, language, content_hash FROM docs WHERE doc_id % 11 <> 0")
def _(s, sf):
    return _synced(s, sf).documents.select("project_id", "file_path", "language", "content_hash")


_COUNTS = ", ".join(f"CAST(count(*) FILTER (WHERE change = '{c}') AS BIGINT) AS {c}" for c in ("added", "modified", "unchanged", "deleted"))


@_query("sync_stats", f"{DIFF} SELECT project_id, {_COUNTS} FROM diff GROUP BY project_id")
def _(s, sf):
    return _synced(s, sf).stats.select("project_id", "added", "modified", "unchanged", "deleted")


@_query("sync_chunks")
def _(s, sf):
    return _synced(s, sf).chunks


UPLOADS = """SELECT n_nationkey AS project_id, source_id FROM nation LEFT JOIN
(SELECT c_nationkey, arg_min(c_custkey, (c_acctbal, c_custkey)) AS source_id FROM customer WHERE c_mktsegment = 'BUILDING' OR c_name LIKE '%7' GROUP BY c_nationkey) ON c_nationkey = n_nationkey"""


@_query("upload_source_lookup", UPLOADS)
def _(s, sf):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "upload").otherwise("git").alias("type")
    name = F.when(F.col("c_name").endswith("7"), "Manual Uploads").otherwise(F.col("c_name")).alias("name")
    sources = _read(s, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"), kind, name, F.col("c_acctbal").alias("created_at"))
    return whole.upload_source_lookup(_read(s, sf, "nation").select(F.col("n_nationkey").alias("project_id")), sources)


RUN = DIFF + """, j AS (SELECT CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status FROM events GROUP BY user_id)
SELECT """ + ", ".join(f"CAST((SELECT count(*) FROM diff WHERE change = '{c}') AS BIGINT) AS files_{c}" for c in ("added", "modified", "unchanged", "deleted")) + """,
  c.chunks, c.tokens, c.embeddings, """ + ", ".join(f"CAST((SELECT count(*) FROM j WHERE status = '{c}') AS BIGINT) AS jobs_{c}" for c in ("running", "completed", "failed")) + f"""
FROM ({CHUNK_SIMS}, given AS (SELECT DISTINCT id, content FROM d) SELECT CAST(count(*) AS BIGINT) AS chunks, CAST(sum({TOKENS}) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS embeddings FROM given) c"""


@_query("run_metrics", RUN)
def _(s, sf):
    status = F.when(F.col("last") == "purchase", "completed").when(F.col("last") == "error", "failed").otherwise("running").alias("status")
    states = _read(s, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last")).select(status)
    return sync_metrics(corpus.sync_diff(*_snapshots(s, sf)), _chunk_table(s, sf).select("token_count", "vector"), states)[0]
