"""Messages, usage, listings and deletes on small tables."""

import pytest
from lorewell.operators import bookkeeping as B


def test_messages_touch_their_conversation(spark):
    conversations = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "conv_id int, updated_at int")
    messages = spark.createDataFrame([(1, "hi", 1, ["x"])], "conv_id int, content string, created_at int, citations array<string>")
    new = spark.createDataFrame([(1, "a", 9), (2, "b", 9), (3, "c", 9), (8, "stray", 9), (None, "stray", 9)], "conv_id int, content string, created_at int")
    touched, all_ = B.append_messages(conversations, messages, new)
    assert sorted(map(tuple, touched.collect())) == [(1, 9), (2, 50), (3, 9)]
    assert sorted((r.content, r.citations) for r in all_.collect()) == [("a", []), ("b", []), ("c", []), ("hi", ["x"])]
    assert B.append_messages(conversations, messages, new.limit(0))[1].count() == 1


def test_usage(spark):
    rows = [(1, "assistant", 10, 100), (1, "assistant", None, 300), (1, "user", 99, 9), (2, "assistant", None, None)]
    got = sorted(map(tuple, B.answer_usage(spark.createDataFrame(rows, "conv_id int, role string, tokens_used int, duration_ms int")).collect()))
    assert got == [(1, 2, 10, 200.0, 200.0, 290.0), (2, 1, 0, None, None, None)]


def test_database_sources_are_scoped(spark):
    d = spark.createDataFrame([(1, "p", 7, 1, "s"), (2, "p", 7, 2, "s"), (3, "q", 7, 3, "s")], "id int, project_id string, source_id int, created_at int, password string")
    s = spark.createDataFrame([(7, "n", "idle")], "id int, name string, status string")
    got = B.list_database_sources(d, s, d.filter("project_id = 'p'"))
    assert sorted((r.id, r.place) for r in got.collect()) == [(1, 2), (2, 1)] and "password" not in got.columns
    with pytest.raises(Exception, match="needs a project"):
        B.list_database_sources(d, s, spark.createDataFrame([(None,)], "project_id string")).collect()


def test_deleting_sources(spark):
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    tables = {
        "sources": make([(1,), (2,)], "id int"), "documents": make([(10, 1), (20, 2), (30, None)], "id int, source_id int"), "jobs": make([(1, 1), (2, 2)], "id int, source_id int"),
        "chunks": make([(10, 0), (20, 0), (20, 1), (None, 0)], "document_id int, n int"), "other": make([(1,)], "id int"),
    }
    left = B.delete_sources(tables, make([(2,), (None,)], "id int"))
    assert {k: v.count() for k, v in left.items()} == {"sources": 1, "documents": 2, "jobs": 1, "chunks": 2, "other": 1}


def test_projects_are_found(spark):
    rows = [(1, "Alpha", None, "openai", "local", 0, 1), (2, "beta", "about ALPHA", None, None, 0, 0), (3, "c", "x", "alphaAI", "OpenAI", None, None)]
    p = spark.createDataFrame(rows, "id int, name string, description string, embedding_provider string, llm_provider string, repositories int, documents int")
    got = lambda *a, **k: sorted(r.id for r in B.project_search(p, *a, **k).collect())
    assert got() == [1, 2, 3] and got(" alpha ") == [1, 2, 3] and got("about") == [2] and got(provider="openai") == [1, 3] and got("alpha", active=True) == [1]
