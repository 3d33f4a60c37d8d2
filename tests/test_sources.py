"""Scans, catalogs and streams on small inputs."""

import io
import json
import tarfile
from datetime import datetime

import pytest

from lorewell.functions import markdown as M
from lorewell.functions import scalars as S
from lorewell.operators import catalog
from lorewell.sources import scans
from lorewell.streaming import jobs
from pyspark.sql import functions as F


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", make(F.col("v")).alias("o"))
    return [r.o for r in df.orderBy("i").collect()]


def test_scalars(spark):
    assert column(spark, ["a.GO", "x/b.mjs", "c.markdown", "d.xyz", "e"], S.detect_language) == ["go", "javascript", "markdown", "text", "text"]
    names = ["userPassword", "api_key", "shipping", "author", "author_id", "authority", "name", "session-token", ""]
    assert column(spark, names, S.is_sensitive_column) == [True, True, True, False, False, False, False, True, False]
    paths = ["main.go", "yarn.lock", "a/node_modules/x.js", "img/A.PNG", "go.sum", "src/app.ts", "/build/x.c", "rebuild/x.c"]
    assert column(spark, paths, lambda c: S.should_index(c, F.lit(10))) == [True, False, False, False, False, True, False, True]
    urls = ["http://127.0.0.1/x", "https://10.1.2.3", "https://8.8.8.8/", "ftp://a.b", "http://localhost:80", "http://x.internal", "https://example.org/a", "", "http://172.32.0.1"]
    assert column(spark, urls, S.url_is_safe) == [False, False, True, False, False, False, True, False, True]
    assert column(spark, ["func x", "  class A", "plain", "", "type T"], lambda c: S.is_boundary(c, F.lit("en"))) == [True, True, False, True, False]
    assert column(spark, ["func x", "type T", "def x"], lambda c: S.is_boundary(c, F.lit("Go"))) == [True, True, False]


def test_html():
    html = "<html><head><title>T</title></head><body><h1>A &amp; B</h1><script>x()</script><ul><li>one<ul><li>in</li></ul></li><li>two</li></ul><p>see <a href='/u'>this</a> <a href='#x'>no</a></p><blockquote>q</blockquote><pre><code>a\n  b</code></pre><table><tr><th>h</th><th>i</th></tr><tr><td>1|2</td></tr></table></body></html>"
    md = M.html_to_markdown(html)
    for part in ["# A & B", "- one\n  - in\n- two", "see [this](/u) no", "> q", "```\na\n  b\n```", "| h | i |\n| --- | --- |\n| 1\\|2 |  |"]:
        assert part in md, md
    assert "x()" not in md and M.html_to_markdown(None) == "" and M.html_to_markdown("<p>open <a href='x'>end") == "open [end](x)"


def test_files_archives_uploads(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "node_modules").mkdir(parents=True)
    for name, raw in {"main.go": b"package main\n", "node_modules/x.js": b"x", "blank.py": b" \n", "bin.md": b"a\0b", "deep.md": b"# t"}.items():
        (root / name).write_bytes(raw)
    got = {r.path: r.language for r in scans.scan_code_files(scans.read_files(spark, str(root))).collect()}
    assert got == {"main.go": "go", "deep.md": "markdown"}
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as tar:
        for name in ["top/a.go", "top/d/b.md"]:
            info = tarfile.TarInfo(name)
            info.size = 4
            tar.addfile(info, io.BytesIO(b"text"))
    df = spark.createDataFrame([(bytearray(raw.getvalue()),), (bytearray(b"bad"),)], "bytes binary")
    assert sorted(r.path for r in scans.explode_archives(df).collect()) == ["a.go", "d/b.md"]
    ups = [("x/a.json", b'{"b":1,"a":2}'), ("t.csv", b'h,i\n"a|b","c\nd"\n'), ("bad.json", b"{"), ("e.txt", b" "), ("p.exe", b"x"), ("u.md", b"\xff\xfe")]
    df = spark.createDataFrame([(n, bytearray(b), len(b)) for n, b in ups], "path string, bytes binary, size_bytes long")
    out = {r.path: (r.content, r.error) for r in scans.scan_uploads(df).collect()}
    assert out["a.json"] == ('{\n  "a": 2,\n  "b": 1\n}', None)
    assert out["t.csv"][0] == "| h | i |\n| --- | --- |\n| a\\|b | c d |"
    assert {k: v[1] for k, v in out.items() if v[1]} == {"bad.json": "invalid json", "e.txt": "empty", "p.exe": "unsupported extension", "u.md": "not UTF-8"}


PR = "number int, title string, user struct<login:string>, state string, body string, html_url string, created_at timestamp, merged_at timestamp, closed_at timestamp, draft boolean, head struct<ref:string>, base struct<ref:string>, labels array<struct<name:string>>, additions int, deletions int, changed_files int, pull_request struct<url:string>"
COMMENT = "number int, id long, user struct<login:string>, created_at timestamp, body string, path string, line int"


def test_pull_requests_and_issues(spark):
    t = datetime(2024, 1, 2, 3, 4, 5)
    prs = spark.createDataFrame([(42, "Add Auth!", ("ann",), "closed", "Body", "http://u", t, t, t, False, ("f",), ("main",), [("x",), ("y",)], 3, 1, 2, None), (43, "", ("",), None, None, None, t, None, None, False, ("",), ("",), [], 0, 0, 0, ("u",))], PR)
    said = spark.createDataFrame([(42, 2, ("bob",), t, "nit", "a.go", 7), (42, 1, (None,), t, "ok", None, None), (42, 3, ("c",), t, " ", None, None)], COMMENT)
    got = {r.path: r.content for r in scans.scan_pull_requests(prs, said).collect()}
    md = got["pulls/PR-42-add-auth.md"]
    for part in ["# PR #42: Add Auth!\n\n- **Type**: Pull Request\n", "- **State**: merged\n", "- **Merged**: 2024-01-02T03:04:05Z\n", "- **Branch**: `f` -> `main`\n", "+3 / -1 across 2 files", "- **Labels**: x, y\n", "### @anonymous on 2024-01-02T03:04:05Z:\n\nok", "### @bob on 2024-01-02T03:04:05Z - review on `a.go` (line 7):\n\nnit\n\n---\n\n"]:
        assert part in md, md
    assert md.index("anonymous") < md.index("@bob")
    other = got["pulls/PR-43-untitled.md"]
    assert "*No description provided.*\n" in other and "**State**: open" in other and "Labels" not in other and "Discussion" not in other
    issues = {r.path: r.content for r in scans.scan_issues(prs, said).collect()}
    assert list(issues) == ["issues/ISSUE-42-add-auth.md"] and "- **Closed**: 2024" in issues["issues/ISSUE-42-add-auth.md"]


def test_ddl(spark):
    tables = spark.createDataFrame([("s", "orders", "table", ""), ("s", "v", "view", "all")], "schema string, name string, type string, comment string")
    cols = spark.createDataFrame([("s", "orders", 2, "user_id", "int", True, "", ""), ("s", "orders", 1, "id", "int", False, "", "key"), ("s", "v", 1, "x", "text", True, "'a'", "")], "schema string, table string, position int, column string, data_type string, nullable boolean, default_value string, comment string")
    keys = spark.createDataFrame([("s", "orders", 1, "id")], "schema string, table string, position int, column string")
    foreign = spark.createDataFrame([("s", "orders", 1, "user_id", "s", "users", "id")], "schema string, table string, position int, column string, to_schema string, to_table string, to_column string")
    index = spark.createDataFrame([("s", "orders", 1, "ix", True, "user_id")], "schema string, table string, position int, index string, unique boolean, column_list string")
    docs = {r.path: r.content for r in catalog.table_ddl_document(catalog.catalog_tree(tables, cols, keys, foreign, index), "db", "postgres").collect()}
    bar = "-- " + "=" * 56
    assert docs["schema/s/orders.sql"] == f"{bar}\n-- Table: s.orders\n-- Database: db | Engine: postgres | Type: table\n{bar}\n\nCREATE TABLE s.orders (\n    id int NOT NULL PRIMARY KEY -- key,\n    user_id int,\n    FOREIGN KEY (user_id) REFERENCES s.users(id)\n);\n\n-- Indexes:\nCREATE UNIQUE INDEX ix ON s.orders (user_id);\n\n-- Relationships:\n--   s.orders.user_id -> s.users.id\n\n"
    assert "-- Description: all\n" in docs["schema/s/v.sql"] and "    x text DEFAULT 'a'\n);" in docs["schema/s/v.sql"]
    flags = spark.createDataFrame([("id", False), ("Email", None), ("password_hash", None), ("note", True)], "name string, is_sensitive boolean")
    assert [r.name for r in catalog.drop_sensitive_columns(flags, ["email"]).collect()] == ["id"]


def test_jdbc(spark):
    url = "jdbc:derby:memory:lorewell;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(1, 51).selectExpr("id", "concat('n', id) as name", "'s' as secret").write.jdbc(url, "people", "overwrite", {"driver": driver})
    got = scans.jdbc_rows(spark, url, "people", ["id", "name"], "id", 4, driver=driver)
    assert got.columns == ["id", "name"] and got.count() == 50 and got.rdd.getNumPartitions() == 4
    assert scans.jdbc_url("cockroachdb", "h", "d") == "jdbc:postgresql://h:26257/d" and "databaseName=d" in scans.jdbc_url("sqlserver", "h", "d")
    with pytest.raises(ValueError):
        scans.jdbc_url("oracle", "h", "d")


def test_bucket(spark):
    s = 1_000_000
    df = spark.createDataFrame([(i, "a", at) for i, at in enumerate([0, 0, 0, 0, s])] + [(9, "b", 5), (10, "b", None)], "id int, key string, at long")
    got = {r.id: (r.accepted, r.wait) for r in jobs.token_bucket(df, s, 3).collect()}
    assert got == {0: (True, 0), 1: (True, 0), 2: (True, 0), 3: (False, s), 4: (True, 0), 9: (True, 0)}


def test_streams(spark, tmp_path):
    rows = [("p", "a.md", "markdown", "# a", "1"), ("p", "b.md", "markdown", "# b", "2"), ("p", "c.md", "markdown", "# c", "3")]
    kind = "project_id string, file_path string, language string, text string, content_hash string"
    spark.createDataFrame(rows, kind).write.json(str(tmp_path / "in"))
    old = spark.createDataFrame([("p", "a.md", "", "", "1"), ("p", "b.md", "", "", "0"), ("p", "z.md", "", "", "9")], kind)
    seen = []
    write = lambda diff, chunks: seen.append(({r.file_path: r.change for r in diff.collect()}, sorted(r.id for r in chunks.collect())))
    q = jobs.stream_sync(spark.readStream.schema(kind).json(str(tmp_path / "in")), lambda: old, write, str(tmp_path / "at"))
    q.awaitTermination(60)
    changes = {k: v for diff, _ in seen for k, v in diff.items()}
    assert changes == {"a.md": "unchanged", "b.md": "modified", "c.md": "added"} and sorted(sum((c for _, c in seen), [])) == ["p/b.md", "p/c.md"]

    with open(tmp_path / "e.json", "w") as f:
        for i, (at, src, c) in enumerate([("2024-01-01T00:00:00", "s", "x"), ("2024-01-01T00:01:00", "s", "x"), ("2024-01-01T00:02:00", "s", "y")]):
            f.write(json.dumps({"ts": at, "source_id": src, "commit": c, "event_id": i, "job_id": src, "status": c}) + "\n")
    stream = spark.readStream.schema("ts timestamp, source_id string, commit string, event_id int, job_id string, status string").option("pathGlobFilter", "e.json").json(str(tmp_path))
    for name, df, mode in [("once", jobs.accepted_requests(stream), "append"), ("states", jobs.job_states(stream), "complete")]:
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted(r.commit for r in spark.table("once").collect()) == ["x", "y"]
    assert [(r.job_id, r.status) for r in spark.table("states").collect()] == [("s", "y")]
