"""Queries of conversations, sources and projects, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewell.operators import bookkeeping as B
from lorewell.plans.registry import _query, _read


def _messages(s, sf):
    c = _read(s, sf, "conversations")
    return c.select("conv_id", "role", F.length("text").alias("tokens_used"), ((F.col("conv_id") * 7 + F.col("turn") * 13) % 1000).alias("duration_ms"), F.col("turn").cast("long").alias("created_at"), F.array("role").alias("citations"))


@_query("append_messages", """WITH m AS (SELECT conv_id, CAST(turn AS BIGINT) AS t, false AS added FROM conversations UNION ALL SELECT conv_id, turn + 100, true FROM conversations WHERE role = 'assistant' AND conv_id % 2 = 0)
SELECT conv_id, CAST(count(*) AS BIGINT) AS messages, CAST(count_if(added) AS BIGINT) AS without_citations, CAST(greatest(3, coalesce(max(t) FILTER (WHERE added), 3)) AS BIGINT) AS updated_at FROM m GROUP BY conv_id""")
def _(s, sf):
    m = _messages(s, sf)
    new = m.filter("role = 'assistant' and conv_id % 2 = 0").select("conv_id", "role", "tokens_used", (F.col("created_at") + 100).alias("created_at"), F.lit(None).cast("array<string>").alias("citations"))
    strangers = new.withColumn("conv_id", -1 - F.col("conv_id"))
    conversations, messages = B.append_messages(m.select("conv_id").distinct().withColumn("updated_at", F.lit(3).cast("long")), m, new.union(strangers))
    n = messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.size("citations") == 0).alias("without_citations"))
    return n.join(conversations, "conv_id")


@_query("conversation_usage", """SELECT conv_id, CAST(count(*) AS BIGINT) AS answers, CAST(sum(length(text)) AS BIGINT) AS tokens, round(avg((conv_id * 7 + turn * 13) % 1000), 6) AS mean_ms,
round(quantile_cont(((conv_id * 7 + turn * 13) % 1000)::DOUBLE, 0.5), 6) AS median_ms, round(quantile_cont(((conv_id * 7 + turn * 13) % 1000)::DOUBLE, 0.95), 6) AS p95_ms FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def _(s, sf):
    return B.answer_usage(_messages(s, sf)).withColumns({c: F.round(c, 6) for c in ("mean_ms", "median_ms", "p95_ms")})


@_query("list_database_sources", """SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS project_id, n_name AS name, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS place
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey < 3""")
def _(s, sf):
    n = _read(s, sf, "nation")
    databases = _read(s, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"), F.col("c_nationkey").alias("source_id"), F.col("c_acctbal").alias("created_at"), F.col("c_phone").alias("password") if "c_phone" in _read(s, sf, "customer").columns else F.lit("x").alias("password"))
    sources = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("idle").alias("status"))
    return B.list_database_sources(databases, sources, n.filter("n_regionkey < 3").select(F.col("n_nationkey").alias("project_id"))).select("id", "project_id", "name", "place")


@_query("delete_source_tree", """WITH gone AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0), l AS (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem)
SELECT 'sources' AS kind, CAST(count(*) AS BIGINT) AS n FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'documents', CAST(count(*) AS BIGINT) FROM l WHERE l_suppkey % 3 <> 0
UNION ALL SELECT 'chunks', CAST(count(*) AS BIGINT) FROM l WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM l WHERE l_suppkey % 3 = 0) UNION ALL SELECT 'jobs', CAST(count(*) AS BIGINT) FROM events WHERE user_id % 3 <> 0 OR user_id NOT IN (SELECT s_suppkey FROM supplier)""")
def _(s, sf):
    lines = _read(s, sf, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("id"), F.col("l_suppkey").alias("source_id"))
    tables = {
        "sources": _read(s, sf, "supplier").select(F.col("s_suppkey").alias("id")), "documents": lines, "chunks": lines.select(F.col("id").alias("document_id")),
        "jobs": _read(s, sf, "events").select(F.col("user_id").alias("source_id"), "event_id"),
    }
    left, out = B.delete_sources(tables, tables["sources"].filter("id % 3 = 0")), None
    for name, table in left.items():
        n = table.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = n if out is None else out.union(n)
    return out


@_query("projects_found", """WITH p AS (SELECT n_nationkey AS id, n_name AS name, CASE n_regionkey WHEN 0 THEN NULL ELSE 'region ' || n_regionkey END AS description, CASE n_nationkey % 2 WHEN 0 THEN 'openai' ELSE 'local' END AS e, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS d FROM nation)
SELECT id FROM p WHERE (contains(lower(name), 'nation_1') OR contains(coalesce(description, ''), 'nation_1') OR contains(e, 'nation_1')) AND e = 'openai' AND d > 0""")
def _(s, sf):
    n = _read(s, sf, "nation")
    held = _read(s, sf, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.count("*").alias("documents"))
    description = F.when(F.col("n_regionkey") > 0, F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))).alias("description")
    provider = F.when(F.col("n_nationkey") % 2 == 0, "openai").otherwise("local").alias("embedding_provider")
    p = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), description, provider, F.lit(None).cast("string").alias("llm_provider"), F.lit(0).alias("repositories")).join(held, "id", "left")
    return B.project_search(p, " Nation_1 ", "OpenAI", active=True).select("id")
