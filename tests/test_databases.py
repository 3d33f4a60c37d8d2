"""Ranges of any key over a database, URLs, and the figures that runs leave behind."""

import pytest
from lorewell.operators import metrics
from lorewell.operators.catalog import table_ddl_document
from lorewell.sources import databases
from pyspark.sql import functions as F

URL, DRIVER = "jdbc:derby:memory:ranges;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def people(spark):
    i = F.col("id")
    hot = F.when(i % 3 == 0, "it's").otherwise(F.concat(F.lit("n"), (i * 37 % 100).cast("string")))
    rows = spark.range(200).select(i.alias("id"), hot.alias("name"), F.date_add(F.lit("2024-01-01"), (i % 40).cast("int")).alias("day"), F.lit("s").alias("api_token"))
    rows.write.option("createTableColumnTypes", "name varchar(20), api_token varchar(9)").jdbc(URL, "PEOPLE", "overwrite", DRIVER)
    held = spark._jvm.java.sql.DriverManager.getConnection(URL)
    held.createStatement().executeUpdate('UPDATE PEOPLE SET "name" = NULL WHERE MOD("id", 10) = 0')
    held.close()
    return sorted(((r[0], r[1] if r[0] % 10 else None, *r[2:]) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("key", ["id", "name", "day"])
def test_ranges_are_disjoint_and_complete(spark, people, key):
    got = databases.jdbc_table(spark, URL, "PEOPLE", ["id", "name", "day"], key, 4, **DRIVER)
    assert got.columns == ["id", "name", "day"] and got.rdd.getNumPartitions() in (4, 5, 6)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((r[:3] for r in people), key=repr)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 3 and max(sizes) <= 110


def test_columns_that_are_not_allowed_are_not_asked_for(spark, people):
    got = databases.jdbc_table(spark, URL, "PEOPLE", ["id", "api_token", "name"], "id", 2, excluded=["NAME"], **DRIVER)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.columns == ["id"] and got.count() == 200 and "api_token" not in plan
    with pytest.raises(ValueError):
        databases.jdbc_table(spark, URL, "PEOPLE", ["api_token"], "id", **DRIVER)
    none = spark.createDataFrame([], "id long, name string")
    none.write.jdbc(URL, "NOBODY", "overwrite", DRIVER)
    assert databases.jdbc_table(spark, URL, "NOBODY", ["id", "name"], "id", **DRIVER).count() == 0


def test_urls():
    got = databases.parse_url("postgresql://u%40x:p%2Fw@Host.example:6000/my%20db?sslmode=require")
    assert got == ("postgres", "host.example", 6000, "my db", "u@x", "p/w", {"sslmode": "require"})
    url, options = got.jdbc()
    assert url == "jdbc:postgresql://host.example:6000/my db" and options == {"sslmode": "require", "user": "u@x", "password": "p/w"}
    assert databases.parse_url("mssql://h/?database=d")[:4] == ("sqlserver", "h", 1433, "d") and databases.parse_url("sqlite:///tmp/a.db").database == "/tmp/a.db"
    for bad in ("oracle://u:secret@h/d", "mysql:///d", "h:5432/d", "mysql://u:secret@h:port/d"):
        with pytest.raises(ValueError) as e:
            databases.parse_url(bad)
        assert "secret" not in str(e.value)


def test_figures_of_a_run(spark, tmp_path):
    diff = spark.createDataFrame([("added",), ("added",), ("deleted",)], "change string")
    chunks = spark.createDataFrame([(3, [1.0]), (4, None)], "token_count int, vector array<double>")
    jobs = spark.createDataFrame([("failed",), ("running",), (None,)], "status string")
    row, tables = metrics.sync_metrics(diff, chunks, jobs)
    want = {"files_added": 2, "files_modified": 0, "files_unchanged": 0, "files_deleted": 1, "chunks": 2, "tokens": 7, "embeddings": 1, "jobs_running": 1, "jobs_completed": 0, "jobs_failed": 1}
    assert row.first().asDict() == want and tables["chunks"].count() == 2
    assert metrics.sync_metrics(diff.limit(0), chunks.limit(0), jobs.limit(0))[0].first().tokens == 0


def test_figures_of_a_stream(spark, tmp_path):
    seen = metrics.StreamMetrics()
    spark.streams.addListener(seen)
    try:
        for part in (["added", "deleted"], ["added"]):
            spark.createDataFrame([(c,) for c in part], "change string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            stream = spark.readStream.schema("change string").json(str(tmp_path / "in"))
            stream = stream.observe("files", *[f.alias(c) for c, f in metrics.counts_of("change", metrics.CHANGES, "files_").items()])
            q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
            q.awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(seen)
    assert seen.totals["files"]["files_added"] == 2 and seen.totals["files"]["files_deleted"] == 1


CATALOG = """
CREATE SCHEMA information_schema;
CREATE TABLE information_schema.tables (table_schema VARCHAR(30), table_name VARCHAR(30), table_type VARCHAR(30), table_comment VARCHAR(30));
CREATE TABLE information_schema.columns (table_schema VARCHAR(30), table_name VARCHAR(30), column_name VARCHAR(30), ordinal_position INT, data_type VARCHAR(30), is_nullable VARCHAR(3), column_default VARCHAR(30), column_comment VARCHAR(30));
CREATE TABLE information_schema.table_constraints (constraint_name VARCHAR(30), table_schema VARCHAR(30), table_name VARCHAR(30), constraint_type VARCHAR(30));
CREATE TABLE information_schema.key_column_usage (constraint_name VARCHAR(30), table_schema VARCHAR(30), table_name VARCHAR(30), column_name VARCHAR(30), ordinal_position INT, referenced_table_schema VARCHAR(30), referenced_table_name VARCHAR(30), referenced_column_name VARCHAR(30));
CREATE TABLE information_schema.constraint_column_usage (constraint_name VARCHAR(30), constraint_schema VARCHAR(30), table_schema VARCHAR(30), table_name VARCHAR(30), column_name VARCHAR(30));
INSERT INTO information_schema.tables VALUES ('app', 'users', 'BASE TABLE', ''), ('app', 'orders', 'BASE TABLE', 'what was sold'), ('app', 'v', 'VIEW', NULL), ('pg_catalog', 'pg_class', 'BASE TABLE', NULL), ('other', 'x', 'BASE TABLE', NULL);
INSERT INTO information_schema.columns VALUES ('app', 'users', 'name', 2, 'text', 'YES', NULL, NULL), ('app', 'users', 'id', 1, 'integer', 'NO', NULL, 'key'), ('app', 'orders', 'id', 1, 'integer', 'NO', NULL, NULL), ('app', 'orders', 'user_id', 2, 'integer', 'NO', NULL, NULL), ('app', 'orders', 'status', 3, 'text', 'YES', 'new', NULL), ('other', 'x', 'y', 1, 'int', 'YES', NULL, NULL);
INSERT INTO information_schema.table_constraints VALUES ('users_pk', 'app', 'users', 'PRIMARY KEY'), ('orders_pk', 'app', 'orders', 'PRIMARY KEY'), ('orders_fk', 'app', 'orders', 'FOREIGN KEY');
INSERT INTO information_schema.key_column_usage VALUES ('users_pk', 'app', 'users', 'id', 1, NULL, NULL, NULL), ('orders_pk', 'app', 'orders', 'id', 1, NULL, NULL, NULL), ('orders_fk', 'app', 'orders', 'user_id', 1, 'app', 'users', 'id');
INSERT INTO information_schema.constraint_column_usage VALUES ('orders_fk', 'app', 'app', 'users', 'id')
"""


@pytest.fixture(scope="module")
def catalog(spark):
    """An information_schema made by hand in Derby, which has none of its own."""
    url = "jdbc:derby:memory:catalog;create=true"
    spark.range(1).write.jdbc(url, "LOADED", "overwrite", DRIVER)  # makes Spark load the driver
    held = spark._jvm.java.sql.DriverManager.getConnection(url)
    for sql in CATALOG.split(";"):
        held.createStatement().executeUpdate(sql)
    held.close()
    return url


@pytest.mark.parametrize("engine", ["postgres", "mysql", "sqlserver"])
def test_catalogs(spark, catalog, engine):
    tree = databases.jdbc_catalog(spark, catalog, engine, ["app"], **DRIVER)
    got = {r.name: r for r in tree.collect()}
    assert sorted(got) == ["orders", "users", "v"] and got["v"].type == "view" and got["orders"].comment == "what was sold" and got["users"].comment is None
    assert [(c.column, c.nullable, c.default_value) for c in got["orders"].columns] == [("id", False, None), ("user_id", False, None), ("status", True, "new")]
    assert [k.column for k in got["users"].primary_key] == ["id"] and got["v"].columns == []
    assert [(f.column, f.to_schema, f.to_table, f.to_column) for f in got["orders"].foreign_keys] == ([] if engine == "sqlserver" else [("user_id", "app", "users", "id")])
    plan = tree._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*In(TABLE_SCHEMA, [app])" in plan or "PushedFilters: [*IsNotNull(TABLE_SCHEMA), *EqualTo(TABLE_SCHEMA,app)" in plan or "*EqualTo(TABLE_SCHEMA,app)" in plan


def test_catalog_documents_and_filters(spark, catalog):
    tree = databases.jdbc_catalog(spark, catalog, "postgres", **DRIVER)
    assert sorted(r.name for r in tree.select("name").collect()) == ["orders", "users", "v", "x"]  # the engine's own schemas are left out
    docs = {r.path: r.content for r in table_ddl_document(databases.jdbc_catalog(spark, catalog, "postgres", ["app"], ["orders"], **DRIVER), "shop", "postgres").collect()}
    assert list(docs) == ["schema/app/orders.sql"] and "FOREIGN KEY (user_id) REFERENCES app.users(id)" in docs["schema/app/orders.sql"] and "-- Description: what was sold" in docs["schema/app/orders.sql"]
    for bad in (("sqlite", ["a"]), ("oracle", ["a"]), ("mysql", [])):
        with pytest.raises(ValueError):
            databases.jdbc_catalog(spark, catalog, *bad, **DRIVER)
