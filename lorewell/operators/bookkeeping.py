"""Conversations, their usage, sources and projects as tables that are appended to, listed and deleted from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.operators.corpus import delete_rows
from lorewell.sources.store import project_of


def append_messages(conversations: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conversations(conv_id, updated_at, ...) and messages(conv_id, created_at, citations, ...) after new messages came in: null
    citations are none, and a conversation's updated_at moves on to its newest message, never back. Columns that new
    lacks are null. A message of an unknown conversation is left out, as it could belong to anybody."""
    fits = new.join(conversations.select("conv_id"), "conv_id", "left_semi")
    kind = dict(messages.dtypes)["citations"]
    citations = F.coalesce(F.col("citations").cast(kind) if "citations" in new.columns else F.lit(None).cast(kind), F.array().cast(kind))
    newest = fits.groupBy("conv_id").agg(F.max("created_at").alias("_newest"))
    touched = conversations.join(newest, "conv_id", "left").withColumn("updated_at", F.greatest("updated_at", "_newest")).select(*conversations.columns)
    return touched, messages.unionByName(fits.withColumn("citations", citations), allowMissingColumns=True).select(*messages.columns)


def answer_usage(messages: DataFrame) -> DataFrame:
    """messages(conv_id, role, tokens_used, duration_ms) -> per conversation: answers, tokens, mean, median and 95th percentile of
    the durations of its assistant's messages (null where none is known)."""
    said = messages.filter("role = 'assistant'").groupBy("conv_id")
    share = lambda p: F.percentile(F.col("duration_ms").cast("double"), F.lit(p))
    return said.agg(F.count("*").alias("answers"), F.coalesce(F.sum("tokens_used"), F.lit(0)).cast("long").alias("tokens"), F.avg("duration_ms").alias("mean_ms"), share(0.5).alias("median_ms"), share(0.95).alias("p95_ms"))


def list_database_sources(databases: DataFrame, sources: DataFrame, scope: DataFrame) -> DataFrame:
    """databases(id, project_id, source_id, created_at, ...) with their source's name and status, of the projects of scope, newest
    first within each project by `place`. A null project in scope is an error; passwords are never listed."""
    asked = scope.select(project_of(F.col("project_id")).alias("project_id")).distinct()
    shown = databases.drop("password", "password_encrypted", "connection_url").withColumn("project_id", F.col("project_id").cast("string"))
    met = shown.join(asked, "project_id", "left_semi").join(sources.select(F.col("id").alias("source_id"), "name", "status"), "source_id")
    return met.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("created_at"), "id")))


#: What belongs to what: table -> (table it belongs to, its column there, its own column).
OWNERS = {
    "database_sources": ("sources", "id", "source_id"), "documents": ("sources", "id", "source_id"), "jobs": ("sources", "id", "source_id"),
    "chunks": ("documents", "id", "document_id"),
}


def delete_sources(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """tables (some or all of sources and those of OWNERS) without the sources of gone(id) and all that belongs to them.
    Tables between that aren't given end their branch."""
    left, lost = dict(tables), {"sources": gone.select("id").distinct()}
    left["sources"] = delete_rows(tables["sources"], lost["sources"], ["id"])
    for name, (owner, key, own) in OWNERS.items():
        if name in tables and owner in lost:
            theirs = lost[owner].select(F.col(key).alias(own))
            left[name] = delete_rows(tables[name], theirs, [own])
            if "id" in tables[name].columns:
                lost[name] = tables[name].join(theirs, own, "left_semi").select("id").distinct()
    return left


def project_search(projects: DataFrame, text: str = "", provider: str = "", active: bool = False) -> DataFrame:
    """projects(name, description, embedding_provider, llm_provider, repositories, documents) whose name, description or
    providers hold the text (any case), of the provider where one is named, and with repositories or documents where
    only active ones are asked for. Nulls hold nothing."""
    holds = lambda c: F.coalesce(F.lower(c).contains(text.strip().lower()), F.lit(False))
    where: Column = F.lit(True)
    if text.strip():
        where = holds("name") | holds("description") | holds("embedding_provider") | holds("llm_provider")
    if provider:
        where = where & ((F.lower("embedding_provider") == provider.lower()) | (F.lower("llm_provider") == provider.lower()))
    if active:
        where = where & (F.coalesce("repositories", F.lit(0)) + F.coalesce("documents", F.lit(0)) > 0)
    return projects.filter(where)
