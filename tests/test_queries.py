"""Every query of the registry that has SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from lorewell import plans
from lorewell.functions import scalars as S
from lorewell.operators import answers, catalog
from lorewell.operators.corpus import chunk_spans, delete_cascade, hybrid_retrieve, rejected, rrf, sync_diff, update_source_status, upsert, vector_topk
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 6) if isinstance(v, float) else v if isinstance(v, int | str | bool | type(None)) else str(v)
    return sorted(([value(r[i]) for i in order] for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = plans.queries()[name](spark, SF)
    got = con.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.collect(), df.columns) == rows(got.fetchall(), columns)


def test_chunks_cover_all_lines():
    lines = ["word " * 400] * 4 + ["", "x"]
    spans = chunk_spans(lines, 300, 20, 100)
    assert spans[0][0] == 0 and spans[-1][1] == len(lines) and len(spans) > 1
    assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(spans, spans[1:], strict=False))


def test_rrf_counts_a_key_once_per_ranking(spark):
    df = spark.createDataFrame([(1, "A", 1, 1), (1, "B", 1, 2), (1, "B", 2, 1), (1, "C", 2, 2), (1, "A", 2, 3), (1, "A", 2, 4)], "query_id int, key string, ranking int, rank int")
    got = {r.key: r.score for r in rrf(df, 10).collect()}
    assert got == pytest.approx({"A": 1 / 11 + 1 / 13, "B": 1 / 12 + 1 / 11, "C": 1 / 12})


def test_sync_diff(spark):
    make = lambda *x: spark.createDataFrame([("p", *r) for r in x], "project_id string, file_path string, content_hash string")
    got = sync_diff(make(("main.go", "1"), ("utils.go", "1"), ("old.go", "1")), make(("main.go", "1"), ("utils.go", "2"), ("new.go", "1")))
    assert {r.file_path: r.change for r in got.collect()} == {"main.go": "unchanged", "utils.go": "modified", "old.go": "deleted", "new.go": "added"}


def test_sync_diff_with_null_hashes(spark):
    make = lambda *x: spark.createDataFrame([("p", *r) for r in x], "project_id string, file_path string, content_hash string")
    got = sync_diff(make(("a", None), ("b", None), ("c", "1")), make(("a", None), ("b", "1"), ("d", None)))
    assert {r.file_path: r.change for r in got.collect()} == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "added"}


def test_upsert(spark):
    kind = "k int, v string, made int"
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, None, None)], kind)
    new = spark.createDataFrame([(2, None, 9), (3, "c", 9), (3, "c", 9), (4, "d", 9), (None, "x", 9)], kind)
    assert sorted(map(tuple, upsert(old, new, ["k"], ["v"]).collect())) == [(1, "a", 1), (2, None, 1), (3, "c", None), (4, "d", 9)]
    rows = spark.createDataFrame([(1, [0.1]), (2, []), (3, None), (None, [0.1])], "k int, e array<float>")
    assert [r.k for r in rows.filter(~rejected(rows, ["k", "e"])).collect()] == [1]


def test_update_source_status(spark):
    kind = "source string, status string, last_commit string, synced_at timestamp"
    old, new = spark.createDataFrame([("a", "idle", "c1", None), ("b", "idle", "c1", None)], kind), spark.createDataFrame([("a", "synced", "", None)], kind)
    assert {r.source: (r.status, r.last_commit) for r in update_source_status(old, new).collect()} == {"a": ("synced", "c1"), "b": ("idle", "c1")}


def one(spark, make, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(make(F.col("v"))).collect()]


def test_scalars_by_hand(spark):
    assert one(spark, S.redact_credentials, "Password = TopSecret x", "DB_PASSWORD=hunter2", "apikey: abc", "password=a,b;c", "postgres://admin:secret12345@h/d", "token=a&b=c") == ["Password=****** x", "DB_PASSWORD=******", "apikey:******", "password=******;c", "postgres://admin:******@h/d", "token=******&b=c"]
    assert one(spark, S.html_title, "<title>a &amp; b &lt;c&gt;\n d</title>", "<p>x</p>") == ["a & b <c> d", ""]
    assert one(spark, lambda c: S.title_from_text(c, F.lit("https://h.example/docs/page.html")), "\n  # Head \nx", "y" * 200, "\n \n", "short") == ["Head", "y" * 80 + "...", "page", "short"]
    assert one(spark, S.content_type_supported, "text/html; charset=utf-8", "Application/JSON", "image/png", "text/odd", None, "application/pdf") == [True, True, False, True, False, False]
    key = F.lit("k" * 32)
    assert one(spark, lambda c: S.decrypt_column(S.encrypt_column(c, key), key), "postgres://u:p@h/d", "", None) == ["postgres://u:p@h/d", "", None]
    assert one(spark, lambda c: S.encrypt_column(c, key), "same", "same")[0] != "same" and len(set(one(spark, lambda c: S.encrypt_column(c, key), "same", "same"))) == 2


def test_row_batches(spark):
    rows = spark.createDataFrame([(i, f"n{i}", None) for i in range(25)], "id int, name string, price double")
    got = {r.path: r for r in catalog.row_batch_documents(rows, "id", "public", "products", "shop", "postgres", batch=10).collect()}
    assert sorted(got) == [f"data/public/products_batch_{k}.jsonl" for k in (1, 2, 3)]
    first = got["data/public/products_batch_1.jsonl"].content.split("\n")
    assert first[:4] == ["-- Database Records: public.products (Batch 1)", "-- Database: shop | Engine: postgres | Total Records: 10", "", '{"id":0,"name":"n0","price":null}'] and len(first) == 14
    assert [r.row_index for r in catalog.numbered(rows, "id", per=4).orderBy("id").collect()] == list(range(25))


def test_retrieval_filters(spark):
    q = spark.createDataFrame([(1, "p", "find me", [1.0, 0.0])], "query_id int, project_id string, query string, query_vector array<double>")
    c = spark.createDataFrame([("p", 1, [1.0, 0.0], "find me here", "a/x.go"), ("p", 2, [0.0, 1.0], "other", "b/y.go"), ("o", 3, [1.0, 0.0], "find me", "a/z.go")], "project_id string, id int, vector array<double>, content string, file_path string")
    assert [r.id for r in hybrid_retrieve(q, c).orderBy("place").collect()] == [1, 2]
    assert [r.id for r in hybrid_retrieve(q, c, least=0.5).collect()] == [1] and [r.id for r in hybrid_retrieve(q, c, filters=["b/"]).collect()] == [2]


def test_rrf_keeps_the_largest_similarity_and_the_first_path(spark):
    rows = [(1, "A", 1, 1, 0.2, ""), (1, "A", 2, 3, 0.5, "a.md"), (1, "B", 2, 1, None, None)]
    df = spark.createDataFrame(rows, "query_id int, key string, ranking int, rank int, similarity double, file_path string")
    assert {r.key: (r.similarity, r.file_path) for r in rrf(df).collect()} == {"A": (0.5, "a.md"), "B": (None, None)}


def test_topk_over_hot_project_and_odd_rows(spark):
    rows = [("p", i, [1.0, i / 500]) for i in range(500)] + [("p", 900, None), ("p", 901, []), ("p", 902, [0.0, 0.0]), (None, 903, [1.0, 0.0]), ("o", 904, [1.0, 0.0])]
    d = spark.createDataFrame(rows, "project_id string, id int, vector array<float>").withColumn("name", F.concat(F.lit("n"), "id"))
    q = spark.createDataFrame([(1, "p", [1.0, 0.0]), (2, None, [1.0, 0.0]), (3, "none", [1.0, 0.0]), (4, "p", [0.0, 0.0])], "query_id int, project_id string, query_vector array<float>")
    got = sorted((r.query_id, r["rank"], r.id, r.name) for r in vector_topk(q, d, 7).collect())
    assert got == [(1, i + 1, i, f"n{i}") for i in range(7)] + [(4, i + 1, i, f"n{i}") for i in range(7)]
    assert vector_topk(q.limit(0), d).count() == 0 and vector_topk(q, d.limit(0)).count() == 0
    assert [r.id for r in vector_topk(q.filter("query_id = 1"), d.withColumn("norm", S.vector_norm(F.col("vector"))), 3).orderBy("rank").collect()] == [0, 1, 2]


def test_delete_cascade(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id int, source string")
    chunks = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (None, 0)], "doc_id int, chunk_index int")
    gone = spark.createDataFrame([("b",), (None,)], "source string")
    left = delete_cascade({"document": docs, "chunk": chunks}, gone, [("document", ["source"]), ("chunk", ["doc_id"])])
    assert sorted(r.doc_id for r in left["document"].collect()) == [1, 3]
    assert sorted((str(r.doc_id), r.chunk_index) for r in left["chunk"].collect()) == [("1", 0), ("None", 0)]


def test_stray_markers_are_stripped(spark):
    told = spark.createDataFrame([(1, "See [1], [^2], [02], [9] and [99999999999]."), (2, None), (3, "none")], "query_id int, answer string")
    have = spark.createDataFrame([(1, 1), (1, 2)], "query_id int, number int")
    got = {r.query_id: r.stripped for r in answers.citation_check(told, have).collect()}
    assert got == {1: "See [1], [^2], [02],  and .", 2: None, 3: "none"}


def test_urls_and_globs_by_hand(spark):
    for url, safe in {"http://127.1/": False, "http://[::1]/": False, "http://LOCALHOST./": False, "http://0x7f.1": False, "http://2130706433/": False, "http://8.8.8.8/x": True, "https://a.example./": True, "http://10.0.0.1.": False, "http://999.1.1.1/": False, "ftp://a.example": False}.items():
        assert one(spark, S.url_is_safe, url) == [safe], url
    got = lambda filters, *paths: one(spark, lambda c: S.file_filter(c, filters), *paths)
    assert got(["a[0-9].go"], "src/a1.go", "src/ab.go") == [True, False] and got(["[^a-c]x", "\\*.md"], "dx", "ax", "*.md", "b.md") == [True, False, True, False]
    assert got(["[a", "b["], "a", "b", "") == [False, False, True] and got(["src/*"], "src/a/b", "lib/a") == [True, False]
    rows = spark.createDataFrame([("src/a1.go", ["*.md", "a[0-9].go"]), ("src/a1.go", ["*.md"]), ("x", None), ("", ["y"]), ("lib/q", ["lib/**"])], "p string, f array<string>")
    assert [r[0] for r in rows.select(S.path_matches(F.col("p"), S.compiled_filters(F.col("f")))).collect()] == [True, False, True, True, True]
