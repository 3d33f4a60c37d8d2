"""Whole syncs on small tables: what stays, what is embedded, and that a second run changes nothing."""

import numpy as np
from lorewell.functions import scalars as S
from lorewell.operators import catalog, ingest
from pyspark.sql import functions as F

DOCUMENT = "project_id string, file_path string, language string, content_hash string, total_chunks long"
CHUNK = "project_id string, file_path string, chunk_index int, start_line int, end_line int, content string, token_count int, content_hash string, vector array<float>"


def filled(value):
    return lambda texts: np.full((len(texts), 2), value, np.float32)


def run(spark, done):
    documents = spark.createDataFrame([tuple(r) for r in done.documents.collect()], DOCUMENT)
    return documents, spark.createDataFrame([tuple(r) for r in done.chunks.collect()], CHUNK), {r.project_id: r for r in done.stats.collect()}


def scan(spark, rows):
    return spark.createDataFrame(rows, "project_id string, file_path string, language string, text string").withColumn("content_hash", S.content_hash(F.col("text")))


def test_sync_corpus(spark):
    nothing = spark.createDataFrame([], DOCUMENT), spark.createDataFrame([], CHUNK)
    first = scan(spark, [("a", "x.md", "markdown", "one"), ("a", "y.md", "markdown", "two"), ("b", "x.md", "markdown", "one"), ("a", "blank.md", "markdown", " \n"), (None, "z", "", "lost"), ("a", "y.md", "markdown", "two")])
    docs, chunks, stats = run(spark, ingest.sync_corpus(*nothing, first, filled(1)))
    assert {(r.project_id, r.file_path): r.total_chunks for r in docs.collect()} == {("a", "x.md"): 1, ("a", "y.md"): 1, ("b", "x.md"): 1, ("a", "blank.md"): 0}
    assert (stats["a"].added, stats["a"].chunks, stats["a"].embedded, stats["b"].embedded) == (3, 2, 2, 1)

    same_docs, same_chunks, stats = run(spark, ingest.sync_corpus(docs, chunks, first, filled(1)))
    assert sorted(same_docs.collect()) == sorted(docs.collect()) and sorted(same_chunks.collect()) == sorted(chunks.collect())
    assert all((s.added, s.modified, s.deleted, s.chunks, s.embedded) == (0,) * 5 for s in stats.values())

    second = scan(spark, [("a", "x.md", "markdown", "three"), ("a", "copy.md", "markdown", "two"), ("b", "x.md", "markdown", "two")])
    docs, chunks, stats = run(spark, ingest.sync_corpus(docs, chunks, second, filled(2)))
    got = {(r.project_id, r.file_path): (r.content, r.vector[0]) for r in chunks.collect()}
    assert got == {("a", "x.md"): ("three", 2.0), ("a", "copy.md"): ("two", 1.0), ("b", "x.md"): ("two", 2.0)}  # never across projects
    assert (stats["a"].added, stats["a"].modified, stats["a"].deleted, stats["a"].saved, stats["b"].saved) == (1, 1, 2, 1, 0)


def test_fallback(spark):
    docs = spark.createDataFrame([(1, "a\r\nb"), (2, " "), (3, "c"), (4, None)], "id int, text string")
    none = spark.createDataFrame([(3, 0, 1, 1, "c", "h", 1)], "id int, chunk_index int, start_line int, end_line int, content string, content_hash string, token_count int")
    got = {r.id: (r.content, r.end_line) for r in ingest.single_chunk_fallback(docs, none).collect()}
    assert got == {1: ("a\nb", 2), 3: ("c", 1)}


def test_database(spark):
    constraints = spark.createDataFrame([("pk", "s", "users", "PRIMARY KEY"), ("pk2", "s", "orders", "PRIMARY KEY"), ("fk", "s", "orders", "FOREIGN KEY"), ("u", "s", "users", "UNIQUE")], "constraint_name string, table_schema string, table_name string, constraint_type string")
    usage = spark.createDataFrame([("pk", "s", "users", "id", 1), ("pk2", "s", "orders", "id", 1), ("fk", "s", "orders", "user_id", 1), ("u", "s", "users", "email", 1)], "constraint_name string, table_schema string, table_name string, column_name string, ordinal_position int")
    target = spark.createDataFrame([("fk", "s", "s", "users", "id"), ("pk", "s", "s", "users", "id")], "constraint_name string, constraint_schema string, table_schema string, table_name string, column_name string")
    keys, foreign = catalog.catalog_pk_join(constraints, usage), catalog.catalog_fk_join(constraints, usage, target)
    assert sorted(tuple(r) for r in keys.collect()) == [("s", "orders", 1, "id"), ("s", "users", 1, "id")]
    assert [tuple(r) for r in foreign.collect()] == [("s", "orders", 1, "user_id", "s", "users", "id")]

    names = spark.createDataFrame([("s", "users"), ("s", "orders"), ("pg_catalog", "pg_class"), ("t", "users")], "table_schema string, table_name string")
    kept = lambda *a: sorted(tuple(r) for r in catalog.catalog_filter(names, "postgres", *a).collect())
    assert kept() == [("s", "orders"), ("s", "users"), ("t", "users")]
    assert kept(["pg_catalog"]) == [("pg_catalog", "pg_class")] and kept([], ["users"]) == [("s", "users"), ("t", "users")]

    tables = catalog.catalog_filter(names, "postgres", ["s"]).select(F.col("table_schema").alias("schema"), F.col("table_name").alias("name"), F.lit("table").alias("type"), F.lit("").alias("comment"))
    index = spark.createDataFrame([], "schema string, table string, position int, index string, unique boolean, column_list string")

    def tree(*more):
        rows = [("s", "users", 1, "id"), ("s", "orders", 1, "id"), ("s", "orders", 2, "user_id"), *more]
        columns = spark.createDataFrame([(*r, "int", True, "", "") for r in rows], "schema string, table string, position int, column string, data_type string, nullable boolean, default_value string, comment string")
        return catalog.catalog_tree(tables, columns, keys, foreign, index)

    data = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "id int, name string")
    nothing = spark.createDataFrame([], DOCUMENT), spark.createDataFrame([], CHUNK)
    ingested = lambda docs, chunks, t, mode: run(spark, ingest.database_ingest(docs, chunks, t, "p", "db", "postgres", filled(1), [(data, "id", "s", "users")], mode))
    docs, chunks, _ = ingested(*nothing, tree(), "schema_and_data")
    assert sorted(r.file_path for r in docs.collect()) == ["data/s/users_batch_1.jsonl", "schema/s/orders.sql", "schema/s/users.sql"]
    docs, chunks, stats = ingested(docs, chunks, tree(("s", "users", 2, "phone")), "schema")
    assert (stats["p"].modified, stats["p"].unchanged, stats["p"].deleted) == (1, 1, 1)
    assert sorted({r.file_path for r in chunks.collect()}) == ["schema/s/orders.sql", "schema/s/users.sql"]
