"""Queries that write a chunk store, change it and read it back, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.operators.ann import AnnIndex
from lorewell.plans.answers import CHUNK_SIMS, FOUND, HITS, TOKENS, _chunk_table, _found
from lorewell.plans.registry import _query, _retrieval
from lorewell.sources.staging import new_folder
from lorewell.sources.store import ChunkStore


def _rows(s, sf):
    c = _chunk_table(s, sf).withColumnRenamed("vector", "embedding")
    return c.withColumn("document_id", F.col("doc_id").cast("string")).drop("doc_id")


def _back(store, rows):
    found = store.read(rows.select("project_id"))
    return found.select(F.col("document_id").cast("long").alias("doc_id"), "project_id", "chunk_index", "id", "start_line", "end_line", F.col("token_count").cast("long").alias("token_count"), F.sha2("content", 256).alias("content"))


PARTS = f"{CHUNK_SIMS[: CHUNK_SIMS.index(chr(10) + 'd AS (SELECT') + 1]}d AS (SELECT file_path || ':' || start_line || ':' || end_line AS id, ch.doc_id, project_id, chunk_index, start_line, end_line, array_to_string(lines[start_line:end_line], chr(10)) AS content FROM ch JOIN docs ON docs.doc_id = ch.doc_id JOIN parts ON parts.doc_id = ch.doc_id JOIN embeddings ON vec_id = ch.doc_id)"
SHOWN = f"doc_id, project_id, chunk_index, id, start_line, end_line, {TOKENS} AS token_count, sha256(content) AS content"


@_query("chunk_store_upsert", f"""{PARTS} SELECT doc_id, project_id, chunk_index, CASE WHEN chunk_index < 2 THEN id ELSE id || '+' END AS id, start_line, end_line, CASE WHEN changed THEN -1 ELSE {TOKENS} END AS token_count, sha256(CASE WHEN changed THEN 'new ' || content ELSE content END) AS content
FROM (SELECT *, doc_id % 3 = 0 AND NOT (doc_id % 7 = 0 AND chunk_index = 0) AS changed FROM d) WHERE chunk_index < 2 OR changed""")
def _(s, sf):
    rows, store = _rows(s, sf), ChunkStore(s, new_folder(s, "store"))
    store.upsert(rows.filter("chunk_index < 2"))
    again = rows.filter("document_id % 3 = 0").withColumn("id", F.concat("id", F.lit("+"))).withColumn("content", F.concat(F.lit("new "), "content")).withColumn("token_count", F.lit(-1))
    again = again.withColumn("embedding", F.when((F.col("document_id") % 7 == 0) & (F.col("chunk_index") == 0), F.array().cast("array<float>")).otherwise(F.col("embedding")))
    for _ in range(2):  # the second time changes nothing
        store.upsert(again)
    return _back(store, rows)


@_query("chunk_store_replace", f"{PARTS} SELECT {SHOWN} FROM d WHERE project_id <> 'src3' AND doc_id % 5 <> 0 AND (doc_id % 3 <> 0 OR chunk_index < 1)")
def _(s, sf):
    rows, store = _rows(s, sf), ChunkStore(s, new_folder(s, "store"))
    store.upsert(rows)
    store.replace_documents(rows.filter("document_id % 3 = 0 and chunk_index < 1"))
    store.delete_documents(rows.filter("document_id % 5 = 0").select("project_id", "document_id").distinct())
    store.delete_projects(rows.filter("project_id = 'src3'"))
    return _back(store, rows)


@_query("chunk_store_rejected", f"{PARTS} SELECT doc_id, chunk_index, CAST(count(*) AS BIGINT) AS n FROM d WHERE doc_id % 7 = 0 AND chunk_index = 0 GROUP BY doc_id, chunk_index")
def _(s, sf):
    rows, store = _rows(s, sf), ChunkStore(s, new_folder(s, "store"))
    store.upsert(rows.withColumn("embedding", F.when((F.col("document_id") % 7 != 0) | (F.col("chunk_index") > 0), F.col("embedding"))))
    return store.rejected().groupBy(F.col("document_id").cast("long").alias("doc_id"), "chunk_index").agg(F.count("*").alias("n"))


@_query("chunk_store_retrieve", f"{HITS} {FOUND}")
def _(s, sf):
    rows, store = _rows(s, sf), ChunkStore(s, new_folder(s, "store"))
    store.upsert(rows)
    return _found(store.retrieve(_retrieval(s, sf)[0]))


@_query("ann_index_topk")
def _(s, sf):
    """The k likeliest rows through the index; no SQL, as it is approximate: its recall is measured in the tests."""
    asked, d = _retrieval(s, sf)
    index = AnnIndex(s, new_folder(s, "index"))
    index.build(d.select("project_id", "id", "vector"))
    return index.search(asked).select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"))
