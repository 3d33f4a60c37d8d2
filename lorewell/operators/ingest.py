"""Whole syncs: from what is stored and what was scanned to new documents, chunks and figures."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.functions import scalars as S
from lorewell.operators import catalog, corpus, vectors
from lorewell.sources.staging import staged

KEY = ["project_id", "file_path"]
CHUNK = [*KEY, "chunk_index", "start_line", "end_line", "content", "token_count", "content_hash", "vector"]


class Synced(NamedTuple):
    """documents(project_id, file_path, language, content_hash, total_chunks), chunks (columns CHUNK) and, per project, stats."""

    documents: DataFrame
    chunks: DataFrame
    stats: DataFrame


def single_chunk_fallback(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunks, and one chunk of the whole text for each of docs(id, text) that has none though its text isn't blank."""
    bare = docs.filter(S.non_blank(F.col("text"))).join(chunks.select("id").distinct(), "id", "left_anti")
    text = S.normalize_newlines(F.col("text"))
    lines = F.size(F.split(text, "\n"))
    whole = bare.select("id", F.lit(0).alias("chunk_index"), F.lit(1).alias("start_line"), lines.alias("end_line"), text.alias("content"))
    whole = whole.select("*", S.content_hash(F.col("content")).alias("content_hash"), S.estimate_tokens(F.col("content")).alias("token_count"))
    return chunks.unionByName(whole)


def _chunks_of(files: DataFrame) -> DataFrame:
    """Chunks of files(project_id, file_path, language, text). The key goes through the chunker as one string."""
    docs = files.select(F.concat("project_id", F.lit("\0"), "file_path").alias("id"), "text", "language")
    made = single_chunk_fallback(docs, corpus.chunk_documents(docs))
    at = F.split("id", "\0", 2)
    return made.select(at[0].alias("project_id"), at[1].alias("file_path"), *[c for c in CHUNK[2:] if c != "vector"])


def sync_corpus(documents: DataFrame, chunks: DataFrame, scanned: DataFrame, embed: Callable[[list[str]], np.ndarray]) -> Synced:
    """documents and chunks as stored, scanned(project_id, file_path, language, text, content_hash) as it is now.

    What was added or modified is chunked; a text that the project has a vector of keeps it, each other one is embedded
    once a project; chunks of what was modified or deleted go. An equal scan changes nothing. Rows without a project or a
    path are left out; of scanned rows with one key one stays (that of the largest hash). What was chunked and embedded is
    staged in the shared folder, so it is done once however often the results are read. Read the stored tables and write
    to new ones."""
    scanned = scanned.filter(~corpus.rejected(scanned, KEY)).groupBy(*KEY).agg(F.max_by(F.struct("language", "text", "content_hash"), "content_hash").alias("x")).select(*KEY, "x.*")
    diff = corpus.sync_diff(documents.select(*KEY, "content_hash"), scanned.select(*KEY, "content_hash"))
    changed = diff.filter(F.col("change").isin("added", "modified")).select(*KEY)
    stale = diff.filter(F.col("change").isin("modified", "deleted")).select(*KEY)
    files = scanned.join(changed, KEY, "left_semi")
    made = staged(_chunks_of(files))  # read four times below

    known = chunks.filter("vector is not null").groupBy("project_id", "content_hash").agg(F.min("vector").alias("vector"))
    texts = made.groupBy("project_id", "content_hash").agg(F.min("content").alias("content"))
    cached = texts.join(known, ["project_id", "content_hash"])
    missing = texts.join(known, ["project_id", "content_hash"], "left_anti")
    fresh_vectors = staged(vectors.embed_chunks(missing, embed).select("project_id", "content_hash", "vector"))
    found = cached.select("project_id", "content_hash", "vector").union(fresh_vectors)
    new = made.join(found, ["project_id", "content_hash"]).select(*CHUNK)

    counts = made.groupBy(*KEY).agg(F.count("*").alias("n"))
    fresh = files.join(counts, KEY, "left").select(*KEY, "language", "content_hash", F.coalesce("n", F.lit(0)).alias("total_chunks"))
    kept = corpus.delete_rows(documents, stale, KEY).select(*fresh.columns)

    of = lambda change: F.count_if(F.col("change") == change).alias(change)
    stats = diff.groupBy("project_id").agg(*map(of, ("added", "modified", "unchanged", "deleted")))
    cost = made.groupBy("project_id").agg(F.count("*").alias("chunks"))
    cost = cost.join(fresh_vectors.groupBy("project_id").agg(F.count("*").alias("embedded")), "project_id", "left").withColumn("embedded", F.coalesce("embedded", F.lit(0)))
    stats = stats.join(cost, "project_id", "left").fillna(0, ["chunks", "embedded"]).withColumn("saved", F.col("chunks") - F.col("embedded"))
    return Synced(kept.union(fresh), corpus.delete_rows(chunks, stale, KEY).select(*CHUNK).union(new), stats)


def database_ingest(documents: DataFrame, chunks: DataFrame, tree: DataFrame, project_id: str, database: str, engine: str, embed: Callable[[list[str]], np.ndarray], rows: list[tuple[DataFrame, str, str, str]] = (), mode: str = "schema", most: int = 10_000) -> Synced:
    """sync_corpus() of a database: a document a table of the catalog tree and, where mode is schema_and_data, its rows in
    batches; rows: (table, numeric key, schema, name), of each the first `most` rows, None for all of them. documents and
    chunks: those of this project's database alone, as what isn't in the catalog any more is deleted."""
    if mode not in ("schema", "schema_and_data"):
        raise ValueError(f"unknown mode {mode}")
    parts = [catalog.table_ddl_document(tree, database, engine)]
    if mode == "schema_and_data":
        parts += [catalog.row_batch_documents(t, key, schema, name, database, engine, most=most) for t, key, schema, name in rows]
    found = reduce(DataFrame.union, [p.select("path", "language", "content", "content_hash") for p in parts])
    scanned = found.select(F.lit(project_id).alias("project_id"), F.col("path").alias("file_path"), "language", F.col("content").alias("text"), "content_hash")
    return sync_corpus(documents, chunks, scanned, embed)


def upload_source_lookup(projects: DataFrame, sources: DataFrame) -> DataFrame:
    """projects(project_id) and sources(id, project_id, type, name, created_at) -> project_id, source_id: the project's first
    source for uploads (ties: smallest id), null where one must be created."""
    mine = sources.filter("type = 'upload' or name = 'Manual Uploads'")
    first = mine.groupBy("project_id").agg(F.min_by("id", F.struct("created_at", "id")).alias("source_id"))
    return projects.select("project_id").distinct().join(first, "project_id", "left")
