"""Catalogs of external databases as nested rows and DDL documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.functions import scalars as S
from lorewell.sources.staging import staged


def drop_sensitive_columns(columns: DataFrame, excluded: list[str], auto: bool = True) -> DataFrame:
    """columns(name, is_sensitive): those neither excluded by name (any case) nor, with auto, sensitive by flag or name."""
    out = columns.filter(~F.lower("name").isin([x.lower() for x in excluded])) if excluded else columns
    return out.filter(~(F.coalesce("is_sensitive", F.lit(False)) | S.is_sensitive_column(F.col("name")))) if auto else out


# Schemas that belong to the engine.
SYSTEM_SCHEMAS = {
    "postgres": ["pg_catalog", "information_schema", "crdb_internal"],
    "mssql": ["guest", "INFORMATION_SCHEMA", "sys", "db_owner", "db_securityadmin", "db_accessadmin"],
}


def catalog_filter(rows: DataFrame, engine: str, schemas: list[str] = (), tables: list[str] = (), schema: str = "table_schema", table: str = "table_name") -> DataFrame:
    """Rows of a catalog table of the named schemas and tables; without names, all but the engine's own schemas. Plain
    predicates, so that a JDBC scan takes them down to the database."""
    where = F.col(schema).isin(list(schemas)) if schemas else ~F.col(schema).isin(SYSTEM_SCHEMAS.get(engine, []))
    return rows.filter(where & F.col(table).isin(list(tables)) if tables else where)


_NAMED = ["constraint_name", "table_schema"]


def catalog_pk_join(constraints: DataFrame, usage: DataFrame) -> DataFrame:
    """table_constraints and key_column_usage -> schema, table, position, column of primary keys, as catalog_tree() takes them."""
    keys = constraints.filter("constraint_type = 'PRIMARY KEY'").select(*_NAMED, "table_name")
    met = usage.select(*_NAMED, "table_name", "column_name", "ordinal_position").join(keys, [*_NAMED, "table_name"], "left_semi")
    return met.select(F.col("table_schema").alias("schema"), F.col("table_name").alias("table"), F.col("ordinal_position").alias("position"), F.col("column_name").alias("column"))


def catalog_fk_join(constraints: DataFrame, usage: DataFrame, target: DataFrame) -> DataFrame:
    """table_constraints, key_column_usage and constraint_column_usage -> schema, table, position, column, to_schema, to_table,
    to_column. A key of several columns gives each pair of them, as those tables don't say which belong together."""
    keys = constraints.filter("constraint_type = 'FOREIGN KEY'").select(*_NAMED, "table_name")
    mine = usage.select(*_NAMED, "table_name", "column_name", "ordinal_position").join(keys, [*_NAMED, "table_name"], "left_semi")
    there = target.select("constraint_name", F.col("constraint_schema").alias("table_schema"), F.col("table_schema").alias("to_schema"), F.col("table_name").alias("to_table"), F.col("column_name").alias("to_column"))
    met = mine.join(there, _NAMED)
    return met.select(F.col("table_schema").alias("schema"), F.col("table_name").alias("table"), F.col("ordinal_position").alias("position"), F.col("column_name").alias("column"), "to_schema", "to_table", "to_column")


def catalog_tree(tables: DataFrame, columns: DataFrame, keys: DataFrame, foreign: DataFrame, indexes: DataFrame) -> DataFrame:
    """One row per table (schema, name, type, comment) with ordered arrays: columns, primary_key, foreign_keys, indexes.
    The parts are keyed by (schema, table) and ordered by their position; a column's name is in `column`."""
    on = ["schema", "name"]
    part = lambda df, into, *cols: df.withColumnRenamed("table", "name").groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("position", *cols))).alias(into))
    t = tables.join(part(columns, "columns", "column", "data_type", "nullable", "default_value", "comment"), on, "left")
    t = t.join(part(keys, "primary_key", "column"), on, "left").join(part(foreign, "foreign_keys", "column", "to_schema", "to_table", "to_column"), on, "left")
    t = t.join(part(indexes, "indexes", "index", "unique", "column_list"), on, "left")
    return t.withColumns({c: F.coalesce(c, F.array()) for c in ("columns", "primary_key", "foreign_keys", "indexes")})


def table_ddl_document(tree: DataFrame, database: str, engine: str) -> DataFrame:
    """path, language, content, content_hash of each table's definition."""
    full = F.concat_ws(".", "schema", "name")
    single = F.size("primary_key") == 1
    more = (F.size("primary_key") > 1) | (F.size("foreign_keys") > 0)
    bar = F.lit("-- " + "=" * 56)
    or_none = lambda before, c: F.coalesce(F.concat(F.lit(before), F.nullif(c, F.lit(""))), F.lit(""))

    def column(c: Column, i: Column) -> Column:
        first = F.when(single & (F.get("primary_key", 0)["column"] == c["column"]), " PRIMARY KEY").otherwise("")
        comma = F.when((i < F.size("columns") - 1) | more, ",").otherwise("")
        return F.concat(F.lit("    "), c["column"], F.lit(" "), c["data_type"], F.when(c["nullable"], "").otherwise(" NOT NULL"), or_none(" DEFAULT ", c["default_value"]), first, or_none(" -- ", c["comment"]), comma)

    target = lambda f, open_, close: F.concat(f["to_schema"], F.lit("."), f["to_table"], F.lit(open_), f["to_column"], F.lit(close))
    composite = F.when(F.size("primary_key") > 1, F.array(F.concat(F.lit("    PRIMARY KEY ("), F.array_join(F.transform("primary_key", lambda k: k["column"]), ", "), F.lit(")"), F.when(F.size("foreign_keys") > 0, ",").otherwise("")))).otherwise(F.array().cast("array<string>"))
    links = F.transform("foreign_keys", lambda f, i: F.concat(F.lit("    FOREIGN KEY ("), f["column"], F.lit(") REFERENCES "), target(f, "(", ")"), F.when(i < F.size("foreign_keys") - 1, ",").otherwise("")))
    body = F.array_join(F.concat(F.transform("columns", column), composite, links), "\n")
    index = lambda x: F.concat(F.lit("CREATE "), F.when(x["unique"], "UNIQUE ").otherwise(""), F.lit("INDEX "), x["index"], F.lit(" ON "), full, F.lit(" ("), F.coalesce(F.nullif(x["column_list"], F.lit("")), F.lit("...")), F.lit(");\n"))
    section = lambda head, rows: F.when(F.size(rows) > 0, F.concat(F.lit(head), F.array_join(rows, ""), F.lit("\n"))).otherwise("")
    ties = F.transform("foreign_keys", lambda f: F.concat(F.lit("--   "), full, F.lit("."), f["column"], F.lit(" -> "), target(f, ".", "\n")))
    head = F.concat(bar, F.lit("\n-- Table: "), full, F.lit(f"\n-- Database: {database} | Engine: {engine} | Type: "), F.col("type"), F.lit("\n"), or_none("-- Description: ", F.col("comment")), F.when(F.coalesce("comment", F.lit("")) != "", "\n").otherwise(""), bar, F.lit("\n\n"))
    text = F.concat(head, F.lit("CREATE "), F.upper("type"), F.lit(" "), full, F.lit(" (\n"), body, F.lit("\n);\n\n"), section("-- Indexes:\n", F.transform("indexes", index)), section("-- Relationships:\n", ties))
    out = tree.select(F.concat(F.lit("schema/"), F.concat_ws("/", "schema", "name"), F.lit(".sql")).alias("path"), F.lit("sql").alias("language"), text.alias("content"))
    return out.withColumn("content_hash", S.content_hash(F.col("content")))


def numbered(rows: DataFrame, key: str, per: int | None = None) -> DataFrame:
    """rows with row_index from 0 in order of a key. Rows are dealt by ranges of the key (and of a hash of the whole row, so
    equal keys are spread too), written once, ranked inside their range, and the sizes of the ranges before are added: one row a range. There are as
    many ranges as shuffle partitions, or of about `per` rows each. No task orders the whole table."""
    rows = rows.withColumn("_tie", F.xxhash64(*rows.columns))
    parts = -(-rows.count() // per) if per else int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(rows.repartitionByRange(max(1, parts), key, "_tie").withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(key, "_tie")
    return dealt.join(offsets, "_part").withColumn("row_index", F.row_number().over(inside) - 1 + F.col("_before")).drop("_part", "_before", "_tie")


def row_batch_documents(rows: DataFrame, key: str, schema: str, table: str, database: str, engine: str, batch: int = 1000, most: int | None = None) -> DataFrame:
    """path, language, content, content_hash, size_bytes of each batch of rows: a head of two lines and a blank one, then a
    JSON object a row, names sorted, nulls kept. most: the first rows only, as for a sample of an external table."""
    columns = sorted(rows.columns)
    r = numbered(rows, key)
    r = r.filter(F.col("row_index") < most) if most else r
    line = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    lines = F.array_sort(F.collect_list(F.struct("row_index", line.alias("line"))))
    out = r.groupBy((F.floor(F.col("row_index") / batch) + 1).alias("number")).agg(lines.alias("lines"))
    number = F.col("number").cast("string")
    head = F.concat(F.lit(f"-- Database Records: {schema}.{table} (Batch "), number, F.lit(f")\n-- Database: {database} | Engine: {engine} | Total Records: "), F.size("lines").cast("string"), F.lit("\n\n"))
    text = F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"))
    out = out.select(F.concat(F.lit(f"data/{schema}/{table}_batch_"), number, F.lit(".jsonl")).alias("path"), F.lit("json").alias("language"), text.alias("content"))
    return out.select("*", S.content_hash(F.col("content")).alias("content_hash"), F.octet_length("content").cast("long").alias("size_bytes"))
