"""The chunk store's files, scopes and refusals, the chunk table, and block products against plain ones."""

import os

import numpy as np
import pytest
from lorewell.functions import scalars as S
from lorewell.operators import corpus
from lorewell.operators.corpus import chunk_documents, chunk_spans, vector_topk
from lorewell.sources.store import ChunkStore, ChunkTable, scope_of
from pyspark.sql import functions as F

KIND = "project_id string, document_id string, chunk_index int, content string, embedding array<float>, id string"


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{root}/chunks") for f in fs if f.endswith(".parquet")}


def held(store, scope):
    return sorted((r.project_id, r.document_id, r.chunk_index, r.content, r.id) for r in store.read(scope).collect())


@pytest.fixture
def store(spark, tmp_path):
    out = ChunkStore(spark, str(tmp_path))
    rows = [("a", "1", 0, "x", [1.0], "i1"), ("a", "1", 1, "y", [1.0], "i2"), ("b/=%", "1", 0, "z", [1.0], "i3"), ("c", "9", 0, "w", [2.0], None)]
    out.upsert(spark.createDataFrame(rows, KIND))
    return out


def test_upsert_touches_its_projects_alone(spark, store):
    before, made = files(store.root), store.read("a").select("created_at").distinct().collect()
    new = [("a", "1", 0, "X", [3.0], "other"), ("a", "2", 0, "n", [1.0], "i4"), ("a", "2", 0, "n", [1.0], "i4"), (None, "1", 0, "bad", [1.0], None), ("a", None, 0, "bad", [1.0], None), ("a", "1", 1, "bad", [], None)]
    for _ in range(2):
        store.upsert(spark.createDataFrame(new, KIND))
        assert held(store, "a") == [("a", "1", 0, "X", "i1"), ("a", "1", 1, "y", "i2"), ("a", "2", 0, "n", "i4")]
    after = files(store.root)
    kept = [f for f in before if "project_id=a/" not in f]
    assert kept and all(after[f] == before[f] for f in kept) and not [f for f in before if "project_id=a/" in f and f in after]
    assert store.read("a").filter("document_id = '1'").select("created_at").distinct().collect() == made
    assert store.rejected().count() == 6 and {r.content for r in store.rejected().collect()} == {"bad"}
    assert held(store, ["b/=%"]) == [("b/=%", "1", 0, "z", "i3")] and store.read("c").first().id


def test_replace_and_delete(spark, store):
    store.replace_documents(spark.createDataFrame([("a", "1", 0, "only", [1.0], "n")], KIND))
    assert held(store, "a") == [("a", "1", 0, "only", "n")]  # chunk 1 is gone
    store.delete_documents(spark.createDataFrame([("a", "1"), ("c", "none")], "project_id string, document_id string"))
    assert held(store, "a") == [] and len(held(store, "c")) == 1 and not [f for f in files(store.root) if "project_id=a/" in f]
    store.delete_projects(spark.createDataFrame([("b/=%",)], "project_id string"))
    assert held(store, ["a", "b/=%", "c"])[0][:3] == ("c", "9", 0)
    store.upsert(spark.createDataFrame([], KIND))
    assert store.counts(["c"]).collect()[0].chunks == 1


def test_a_scope_is_needed(spark, store):
    for bad in (None, [None], "", ["a", ""]):
        with pytest.raises(ValueError):
            store.read(bad)
    rows = spark.createDataFrame([("a",), (None,)], "project_id string")
    with pytest.raises(Exception, match="needs a project"):
        store.read(rows).collect()
    with pytest.raises(Exception, match="needs a project"):
        scope_of(rows).collect()
    plan = store.read("a")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "project_id" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_scopes_of_rows_prune_folders_at_run_time(spark, store):
    found = store.read(spark.createDataFrame([("a",), ("a",)], "project_id string"))
    assert found.count() == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    asked = spark.createDataFrame([(1, "a", "x", [1.0])], "query_id int, project_id string, query string, query_vector array<float>")
    assert [r.content for r in store.retrieve(asked, k=1).collect()] == ["x"]


def test_chunk_table_holds_each_text_once(spark, tmp_path):
    text = "# head\n" + "\n".join(f"word {i} " * 30 for i in range(60))
    docs = spark.createDataFrame([(1, text, "md"), (2, text, "markdown"), (3, text, "go"), (4, " \n", "md"), (5, None, "md"), (6, "a\x1cb", "md")], "id int, text string, language string")
    made = ChunkTable(spark, str(tmp_path))
    for _ in range(2):
        made.fill(docs)
    want = chunk_documents(docs.filter("id < 4 or id > 5"))
    cols = ["id", "chunk_index", "start_line", "end_line", "content", "content_hash", "token_count"]
    assert sorted(map(tuple, made.of(docs).select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    assert made.read().select("text_hash", "kind").distinct().count() == 3  # ids 1 and 2 share their chunks
    plan = made.of(docs)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan


def test_white_space_is_what_the_token_count_says(spark):
    row = spark.createDataFrame([("a\x1cb c",), ("　x y",)], "t string").select(S.estimate_tokens(F.col("t"))).collect()
    assert [r[0] for r in row] == [2, 2]
    lines = ["a\x1cb c"] * 60  # 2 tokens each, 120 in all
    assert chunk_spans(lines, 130, 0, 100) == [(0, 60)] and chunk_spans(["\x1c# x"] * 9, 4, 0, 100) == [(0, 4), (4, 8), (8, 9)]


def test_block_products_are_plain_products(spark, monkeypatch):
    monkeypatch.setattr(corpus, "BLOCK_ROWS", 7)
    monkeypatch.setattr(corpus, "BLOCK_QUERIES", 3)
    rng = np.random.RandomState(5)
    v = [("p", f"n{i:03}", [float(x) for x in rng.randn(6)]) for i in range(60)] + [("p", "odd", [1.0]), ("p", "zero", [0.0] * 6), ("p", "none", None), ("q", "n1", [1.0] * 6)]
    v += [("p", "twin", v[3][2])]
    q = [(i, "p" if i % 4 else "q", [float(x) for x in rng.randn(6)]) for i in range(11)] + [(50, "p", None)]
    d = spark.createDataFrame(v, "project_id string, id string, vector array<float>")
    asked = spark.createDataFrame(q, "query_id int, project_id string, query_vector array<double>")
    met = d.join(asked, "project_id").withColumn("s", S.cosine_similarity(F.col("vector"), F.col("query_vector"))).collect()
    want = []
    for i in {x[0] for x in q}:
        mine = sorted(((r.s is None, -(r.s or 0), r.id) for r in met if r.query_id == i), key=lambda x: (x[0], round(x[1], 12), x[2]))[:9]
        want += [(i, n + 1, id_, None if gone else round(-s, 6)) for n, (gone, s, id_) in enumerate(mine)]
    got = vector_topk(asked, d, 9).select("query_id", "rank", "id", F.round("similarity", 6)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    every = corpus.similarities(asked, d, ["project_id"]).select("query_id", "id", F.round("similarity", 9)).collect()
    assert sorted(map(tuple, every), key=repr) == sorted(((r.query_id, r.id, None if r.s is None else round(r.s, 9)) for r in met), key=repr)
