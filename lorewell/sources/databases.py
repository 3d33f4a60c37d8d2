"""Rows of external databases in disjoint ranges of any key, and the URLs that name such databases."""

from __future__ import annotations

from typing import NamedTuple
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import scalars as S
from lorewell.operators.catalog import catalog_filter, catalog_fk_join, catalog_pk_join, catalog_tree, drop_sensitive_columns
from lorewell.sources.scans import DATABASES, jdbc_url

# Other names of the databases.
SCHEMES = {"postgresql": "postgres", "cockroach": "cockroachdb", "mssql": "sqlserver", "sqlite3": "sqlite", "file": "sqlite"}


class Database(NamedTuple):
    kind: str
    host: str
    port: int
    database: str
    user: str
    password: str
    options: dict[str, str]

    def jdbc(self) -> tuple[str, dict[str, str]]:
        """The JDBC URL, without user and password, and the reader's options, with them."""
        login = {k: v for k, v in (("user", self.user), ("password", self.password)) if v}
        return jdbc_url(self.kind, self.host, self.database, self.port or None), self.options | login


def parse_url(url: str) -> Database:
    """scheme://user:password@host:port/database?option=value, parts percent-decoded; a database of SQLite is its path, one of
    SQL Server may be the option `database`. An unknown scheme, or no host where one is needed, is an error that names neither user nor password."""
    parts = urlsplit(url.strip())
    kind = SCHEMES.get(parts.scheme.lower(), parts.scheme.lower())
    if kind not in DATABASES:
        raise ValueError(f"unknown database type {parts.scheme or 'without a scheme'}")
    options = dict(parse_qsl(parts.query))
    if kind == "sqlite":
        return Database(kind, "", 0, unquote(parts.netloc + parts.path), "", "", options)
    try:
        host, port = parts.hostname or "", parts.port or DATABASES[kind][1]
    except ValueError:
        raise ValueError(f"bad port in a URL of {kind}") from None
    if not host:
        raise ValueError(f"no host in a URL of {kind}")
    name = unquote(parts.path.strip("/")) or (options.pop("database", "") if kind == "sqlserver" else "")
    return Database(kind, host, port, name, unquote(parts.username or ""), unquote(parts.password or ""), options)


def allowed_columns(spark: SparkSession, columns: list[str], excluded: list[str] = (), auto: bool = True) -> list[str]:
    """The columns that drop_sensitive_columns() lets through, in their order."""
    rows = spark.createDataFrame([(i, c, False) for i, c in enumerate(columns)], "i int, name string, is_sensitive boolean")
    return [r.name for r in drop_sensitive_columns(rows, list(excluded), auto).orderBy("i").collect()]


def key_ranges(spark: SparkSession, url: str, target: str, key: str, parts: int, **options: str) -> list[str]:
    """Predicates that part a table by a key of text, numbers, dates or times: disjoint, together complete, about equal, and
    one for rows without a key.

    Range ends are quantiles of a sample of 50 values a part, each weighed by its rows. The database says how many rows
    lie below each end and so puts them in its own order, whatever its collation. A value that holds more than a part is
    a range by itself."""
    dialect = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)
    name, read = dialect.quoteIdentifier(key), lambda sql: spark.read.format("jdbc").options(url=url, query=sql, **options).load()
    values = read(f"SELECT {name} AS k, COUNT(*) AS n FROM {target} WHERE {name} IS NOT NULL GROUP BY {name}").toDF("k", "n")
    drawn = sorted((r.k, r.n) for r in values.orderBy(F.xxhash64("k")).limit(50 * parts).collect())
    total, reached, ends = sum(n for _, n in drawn), 0, []
    for value, n in drawn:
        if reached and reached * parts // total != (reached + n) * parts // total:
            ends.append(value)
        reached += n
    jvm = spark._jvm.java.sql
    java = lambda v: jvm.Timestamp.valueOf(str(v)) if hasattr(v, "hour") else jvm.Date.valueOf(str(v)) if hasattr(v, "year") else v
    literal = {v: str(dialect.compileValue(java(v))) if not isinstance(v, int | float) and not hasattr(v, "as_tuple") else str(v) for v in ends}
    if ends:
        counted = read(" UNION ALL ".join(f"SELECT {i} AS i, COUNT(*) AS n FROM {target} WHERE {name} < {literal[v]}" for i, v in enumerate(ends))).toDF("i", "n")
        below = {r.n: ends[r.i] for r in counted.collect()}  # ends that part nothing fall together
        ends = [below[n] for n in sorted(below)]
    at = [literal[v] for v in ends]
    if not at:
        return [f"{name} IS NOT NULL", f"{name} IS NULL"]
    return [f"{name} < {at[0]}", *[f"{name} >= {a} AND {name} < {b}" for a, b in zip(at, at[1:], strict=False)], f"{name} >= {at[-1]}", f"{name} IS NULL"]


def jdbc_table(spark: SparkSession, url: str, name: str, columns: list[str], key: str, parts: int = 8, schema: str | None = None, excluded: list[str] = (), auto: bool = True, **options: str) -> DataFrame:
    """The allowed ones of `columns` of a table, in ranges of `key` read in parallel. Names are those of the catalog and are
    quoted by the dialect. What isn't allowed is never asked for: the database gets a query that names the allowed
    columns and the key alone. No column that is allowed is an error."""
    quote = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
    kept = allowed_columns(spark, columns, excluded, auto)
    if not kept:
        raise ValueError(f"no column of {name} may be read")
    target = ".".join(map(quote, [schema, name] if schema else [name]))
    ranges = key_ranges(spark, url, target, key, parts, **options)
    asked = ", ".join(map(quote, [*kept, *([] if key in kept else [key])]))
    return spark.read.jdbc(url, f"(SELECT {asked} FROM {target}) lorewell_rows", predicates=ranges, properties=dict(options)).select(*[F.col("`" + c.replace("`", "``") + "`") for c in kept])


def _view(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A catalog view of the database with column names in lower case, whatever case the engine gives them."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=f"information_schema.{name}", **options).load()
    return rows.select(*[F.col(c).alias(c.lower()) for c in rows.columns])


def _or_null(rows: DataFrame, name: str):
    return F.nullif(F.col(name).cast("string"), F.lit("")) if name in rows.columns else F.lit(None).cast("string")


def jdbc_catalog(spark: SparkSession, url: str, engine: str, schemas: list[str] = (), tables: list[str] = (), **options: str) -> DataFrame:
    """The catalog of a database as catalog_tree(): a row a table with its columns, primary key, foreign keys and comments.

    Read from the information_schema of PostgreSQL, CockroachDB, MySQL, MariaDB and SQL Server as JDBC relations, so the
    filters on schemas and tables, and the columns that are wanted, are the database's work. Engines differ: MySQL and
    MariaDB say where a foreign key points in key_column_usage and have comments; SQL Server's foreign keys aren't read; indexes have no
    place in information_schema and are left empty. An unknown engine is an error; a schema without tables gives no rows."""
    if engine not in DATABASES or engine == "sqlite":
        raise ValueError(f"no information_schema in {engine}")
    mysql = engine in ("mysql", "mariadb")
    kind = {"cockroachdb": "postgres", "sqlserver": "mssql"}.get(engine, engine)
    if mysql and not schemas:
        raise ValueError("a MySQL catalog needs the names of its schemas")
    get = lambda name: catalog_filter(_view(spark, url, name, **options), kind, schemas, tables)
    t, c = get("tables"), get("columns")
    whole = t.select(F.col("table_schema").alias("schema"), F.col("table_name").alias("name"), S.table_kind(F.col("table_type")).alias("type"), _or_null(t, "table_comment").alias("comment"))
    where = [F.col("table_schema").alias("schema"), F.col("table_name").alias("table")]
    columns = c.select(*where, F.col("ordinal_position").cast("int").alias("position"), F.col("column_name").alias("column"), "data_type", (F.upper("is_nullable") == "YES").alias("nullable"), _or_null(c, "column_default").alias("default_value"), _or_null(c, "column_comment").alias("comment"))
    constraints, usage = get("table_constraints"), get("key_column_usage")
    if mysql:
        to = [F.col(f"referenced_{a}").alias(b) for a, b in (("table_schema", "to_schema"), ("table_name", "to_table"), ("column_name", "to_column"))]
        foreign = usage.filter("referenced_table_name is not null").select(*where, F.col("ordinal_position").alias("position"), F.col("column_name").alias("column"), *to)
    elif kind == "mssql":
        foreign = spark.createDataFrame([], "schema string, table string, position int, column string, to_schema string, to_table string, to_column string")
    else:
        foreign = catalog_fk_join(constraints, usage, _view(spark, url, "constraint_column_usage", **options))
    none = spark.createDataFrame([], "schema string, table string, position int, index string, unique boolean, column_list string")
    return catalog_tree(whole, columns, catalog_pk_join(constraints, usage), foreign, none)
