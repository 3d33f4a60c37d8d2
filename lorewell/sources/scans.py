"""Scans: files, archives, uploads, pages, pull requests, issues and JDBC tables as rows of one shape:
path, language, content, content_hash, size_bytes."""

from __future__ import annotations

import io
import posixpath
import tarfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import markdown as M
from lorewell.functions import scalars as S

MOST_BYTES, UPLOAD_BYTES = 1 << 20, 10 << 20
#: Kinds of databases: JDBC prefix, default port.
DATABASES = {"postgres": ("postgresql", 5432), "cockroachdb": ("postgresql", 26257), "mysql": ("mysql", 3306), "mariadb": ("mariadb", 3306), "sqlserver": ("sqlserver", 1433), "sqlite": ("sqlite", 0)}


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, bytes, size_bytes) of every file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = posixpath.basename(root.rstrip("/"))
    return files.select(F.regexp_replace(F.col("path"), f"^.*?/{base}/", "").alias("path"), F.col("content").alias("bytes"), F.col("length").alias("size_bytes"))


def scanned(rows: DataFrame, path: Column, language: Column, content: Column) -> DataFrame:
    out = rows.select(path.alias("path"), language.alias("language"), content.alias("content"))
    return out.select("*", S.content_hash(F.col("content")).alias("content_hash"), F.octet_length("content").cast("long").alias("size_bytes"))


def scan_code_files(files: DataFrame) -> DataFrame:
    """files(path, bytes, size_bytes): those that should_index() takes and that are neither binary nor blank. Bytes that
    aren't UTF-8 are replaced."""
    kept = files.filter(S.should_index(F.col("path"), F.col("size_bytes")) & ~S.is_binary(F.col("bytes")))
    text = F.make_valid_utf8(F.col("bytes").cast("string"))
    return scanned(kept.filter(S.non_blank(text)), F.col("path"), S.detect_language(F.col("path")), text)


def explode_archives(archives: DataFrame) -> DataFrame:
    """(bytes) of tar.gz archives -> path, bytes, size_bytes of their files, the first folder dropped. A file is read only
    if it is of an indexable size, and rows leave one by one; an unreadable archive gives none."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame.bytes:
                try:
                    with tarfile.open(fileobj=io.BytesIO(raw), mode="r|gz") as tar:
                        for m in tar:
                            name = m.name.removeprefix("./").partition("/")[2]
                            if m.isfile() and name and m.size <= MOST_BYTES:
                                yield pd.DataFrame({"path": [name], "bytes": [tar.extractfile(m).read()], "size_bytes": [m.size]})
                except (tarfile.TarError, OSError, EOFError):
                    continue

    return archives.select("bytes").mapInPandas(work, "path string, bytes binary, size_bytes long")


def scan_uploads(files: DataFrame) -> DataFrame:
    """files(path, bytes, size_bytes) -> path, language, content, error: md and txt as they are, json indented with sorted
    keys, csv as a table. A row that isn't taken has its reason in error and no content."""

    @F.pandas_udf("struct<content string, error string>")
    def parse(text: pd.Series, language: pd.Series) -> pd.DataFrame:
        out = []
        for t, lang in zip(text, language, strict=True):
            try:
                out.append((M.json_pretty(t) if lang == "json" else M.csv_to_markdown(t) if lang == "csv" else t, None) if t is not None else (None, None))
            except ValueError:
                out.append((None, f"invalid {lang}"))
        return pd.DataFrame(out, columns=["content", "error"])

    text = F.col("bytes").cast("string")
    name = S.safe_filename(F.col("path"))
    f = files.select(name.alias("path"), S.upload_language(name).alias("language"), "bytes", "size_bytes")
    wrong = F.when(F.col("path").isNull(), "bad name").when(F.col("language").isNull(), "unsupported extension").when(F.col("size_bytes") > UPLOAD_BYTES, "too large")
    f = f.withColumn("error", wrong.when(~F.is_valid_utf8(text), "not UTF-8").when(~S.non_blank(F.make_valid_utf8(text)), "empty"))
    f = f.withColumn("made", parse(F.when(F.col("error").isNull(), text), F.col("language")))
    return f.select("path", "language", F.col("made.content").alias("content"), F.coalesce("error", "made.error").alias("error"))


def scan_web_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, title, content (Markdown), content_hash. Only safe URLs; a page without
    a title is named by its URL; plain text stays as it is."""

    @F.pandas_udf("string")
    def convert(html: pd.Series) -> pd.Series:
        return html.map(M.html_to_markdown)

    html = F.coalesce("html", F.lit(""))
    body = F.when(html.rlike(r"(?i)<(html|body|p|div|h1|!doctype)[\s>]"), convert(html)).otherwise(S.clean_markdown(html))
    title = F.coalesce(F.nullif(S.html_title(html), F.lit("")), S.title_from_url(F.col("url")))
    out = pages.filter(S.url_is_safe(F.col("url"))).select("page_id", "url", title.alias("title"), body.alias("content"))
    return out.withColumn("content_hash", S.content_hash(F.col("content")))


def _stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _line(name: str, value: Column) -> Column:
    """A bullet, or null (which concat_ws leaves out) where there is no value."""
    return F.concat(F.lit(f"- **{name}**: "), value)


def _some(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _comment(c: Column) -> Column:
    who = F.concat(F.lit("### @"), F.coalesce(_some(c["user"]["login"]), F.lit("anonymous")), F.coalesce(F.concat(F.lit(" on "), _stamp(c["created_at"])), F.lit("")))
    line = F.when(c["line"] > 0, F.concat(F.lit(" (line "), c["line"].cast("string"), F.lit(")"))).otherwise("")
    where = F.when(_some(c["path"]).isNotNull(), F.concat(F.lit(" - review on `"), c["path"], F.lit("`"), line)).otherwise("")
    return F.concat(who, where, F.lit(":\n\n"), F.trim(c["body"]), F.lit("\n\n---\n\n"))


def _rendered(head: Column, bullets: list[Column], heading: str) -> Column:
    body = F.coalesce(_some(F.col("body")), F.lit("*No description provided.*"))
    said = F.filter(F.coalesce("comments", F.array()), lambda c: _some(c["body"]).isNotNull())
    talk = F.when(F.size("comments") > 0, F.concat(F.lit(f"\n## {heading}\n\n"), F.array_join(F.transform(said, _comment), ""))).otherwise("")
    return F.concat(head, F.lit("\n\n"), F.concat_ws("\n", *bullets), F.lit("\n\n## Description\n\n"), body, F.lit("\n"), talk)


def _label_names() -> Column:
    return F.nullif(F.array_join(F.filter(F.transform("labels", lambda x: x["name"]), lambda n: n != ""), ", "), F.lit(""))


def _with_comments(rows: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments (number, kind, id, user, created_at, body, path, line): issue comments first, then review comments."""
    order = F.array_sort(F.collect_list(F.struct((F.col("path") != "").alias("review"), "created_at", "id", "user", "body", "path", "line")))
    said = comments.withColumn("path", F.coalesce("path", F.lit(""))).groupBy("number").agg(order.alias("comments"))
    return rows.join(said, "number", "left")


def _number(kind: str) -> Column:
    return F.concat(F.lit(f"# {kind} #"), F.col("number").cast("string"), F.lit(": "), F.col("title"))


def scan_pull_requests(rows: DataFrame, comments: DataFrame) -> DataFrame:
    r = _with_comments(rows, comments)
    n = F.col("number").cast("string")
    ended = F.coalesce(_line("Merged", _stamp(F.col("merged_at"))), _line("Closed", _stamp(F.col("closed_at"))))
    branch = F.when((F.col("head.ref") != "") | (F.col("base.ref") != ""), F.concat(F.lit("`"), F.col("head.ref"), F.lit("` -> `"), F.col("base.ref"), F.lit("`")))
    size = F.when((F.col("additions") > 0) | (F.col("deletions") > 0) | (F.col("changed_files") > 0), F.format_string("+%d / -%d across %d files", "additions", "deletions", "changed_files"))
    bullets = [
        F.lit("- **Type**: Pull Request"), _line("Number", F.concat(F.lit("#"), n)), _line("Author", F.concat(F.lit("@"), _some(F.col("user.login")))),
        _line("State", S.pr_state(F.col("merged_at"), F.col("state"), F.col("draft"))), _line("Created", _stamp(F.col("created_at"))), ended,
        _line("Branch", branch), _line("Diff Summary", size), _line("Labels", _label_names()), _line("URL", _some(F.col("html_url"))),
    ]
    path = F.concat(F.lit("pulls/PR-"), n, F.lit("-"), S.slugify_title(F.col("title")), F.lit(".md"))
    return scanned(r, path, F.lit("markdown"), _rendered(_number("PR"), bullets, "Discussion & Review Comments"))


def scan_issues(rows: DataFrame, comments: DataFrame) -> DataFrame:
    """Rows that are pull requests are left out."""
    r = _with_comments(rows.filter("pull_request is null"), comments.withColumn("path", F.lit("")))
    n = F.col("number").cast("string")
    bullets = [
        F.lit("- **Type**: Issue"), _line("Number", F.concat(F.lit("#"), n)), _line("Author", F.concat(F.lit("@"), _some(F.col("user.login")))),
        _line("State", S.issue_state(F.col("state"))), _line("Created", _stamp(F.col("created_at"))), _line("Closed", _stamp(F.col("closed_at"))),
        _line("Labels", F.coalesce(_label_names(), F.lit("None"))), _line("URL", _some(F.col("html_url"))),
    ]
    path = F.concat(F.lit("issues/ISSUE-"), n, F.lit("-"), S.slugify_title(F.col("title")), F.lit(".md"))
    return scanned(r, path, F.lit("markdown"), _rendered(_number("Issue"), bullets, "Discussion Comments"))


def scan_corpus(*scans: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, scans)


def jdbc_url(kind: str, host: str, database: str, port: int | None = None) -> str:
    if kind not in DATABASES:
        raise ValueError(f"unknown database type {kind}")
    prefix, default = DATABASES[kind]
    if kind == "sqlite":
        return f"jdbc:sqlite:{database}"
    at = f"jdbc:{prefix}://{host}:{port or default}"
    return f"{at};databaseName={database}" if kind == "sqlserver" else f"{at}/{database}"


def jdbc_rows(spark: SparkSession, url: str, name: str, columns: list[str], key: str, parts: int = 8, **options: str) -> DataFrame:
    """The given columns of a table, read in ranges of a numeric key; the range ends come from the database itself."""
    reader = lambda **kw: spark.read.format("jdbc").options(url=url, **options, **kw)
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    low, high = reader(query=f"SELECT min({quoted}) AS lo, max({quoted}) AS hi FROM {name}").load().first()
    if low is None or low == high:
        return reader(dbtable=name).load().select(*columns)
    return reader(dbtable=name, partitionColumn=key, lowerBound=str(low), upperBound=str(int(high) + 1), numPartitions=str(parts)).load().select(*columns)
