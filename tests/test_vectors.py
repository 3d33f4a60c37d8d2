"""Embeddings by function and approximate neighbours against exact ones."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.operators import corpus, vectors
from lorewell.plans.answers import _retrieval


def test_hash_embedding():
    got = vectors.hash_embedding(["a", "", "a"], 5)
    state, want = int.from_bytes(hashlib.sha256(b"a").digest()[:8], "big"), []
    for _ in range(5):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        want.append((state - (1 << 64) if state >= 1 << 63 else state) / 2**63)
    assert np.allclose(got[0], np.array(want) / np.linalg.norm(want), atol=1e-6) and (got[0] == got[2]).all()


def test_embed_chunks(spark):
    df = spark.createDataFrame([("x",), (None,)], "content string")
    assert sorted(len(r.vector) for r in vectors.embed_chunks(df, vectors.hash_embedding, batch=1).collect()) == [64, 64]
    with pytest.raises(Exception, match="vectors for"):
        vectors.embed_chunks(df, lambda texts: np.zeros((9, 2))).collect()


def test_recall(spark):
    q, d = _retrieval(spark, "/root/testdata/sf0.01")
    near = {(r.query_id, r.id) for r in vectors.ann_topk(q, d, vectors.fit_cells(d)).collect()}
    best = {(r.query_id, r.id) for r in corpus.vector_topk(q, d).collect()}
    assert len(near & best) >= 0.9 * len(best)


def test_index_reads_few_rows_and_finds_nine_in_ten(spark, tmp_path):
    from lorewell.operators.ann import AnnIndex

    q, d = _retrieval(spark, "/root/testdata/sf0.01")
    q, d = q.withColumn("project_id", F.lit("all")).cache(), d.select(F.lit("all").alias("project_id"), "id", "vector").cache()
    index = AnnIndex(spark, str(tmp_path / "index"))
    index.build(d)
    assert index.vectors().count() == d.count() == sum(len(r.codes) for r in index.codes().select("codes").collect())
    want = {(r.query_id, r.id) for r in corpus.nearest(q, d, ["project_id"], 5).collect()}
    got = {(r.query_id, r.id): r for r in index.search(q, 5).collect()}
    recall = len(want & set(got)) / len(want)
    pairs = q.join(d, "project_id").count()
    compared = index.candidates(q, 100).count()
    assert recall >= 0.9 and compared <= pairs / 3, (recall, compared / pairs)
    exact = {(r.query_id, r.id): r.similarity for r in corpus.nearest(q, d, ["project_id"], 5).collect()}
    assert all(abs(exact[k] - r.similarity) < 1e-6 for k, r in got.items() if k in exact)


def test_index_on_odd_rows(spark, tmp_path):
    from lorewell.operators.ann import AnnIndex

    kind, asked = "project_id string, id string, vector array<double>", "query_id int, project_id string, query_vector array<double>"
    rows = [("p", f"n{i}", [float(i % 7), 1.0, float(i % 3)]) for i in range(50)] + [("p", "zero", [0.0] * 3), ("p", "none", None), ("p", "wide", [1.0] * 9), (None, "lost", [1.0] * 3), ("o", "n1", [1.0] * 3)]
    q = spark.createDataFrame([(1, "p", [1.0, 1.0, 1.0]), (2, "none", [1.0] * 3), (3, "o", [1.0] * 3), (4, "p", [1.0])], asked)
    index = AnnIndex(spark, str(tmp_path / "a"))
    index.build(spark.createDataFrame(rows, kind))
    got = index.search(q, 60, probes=1.0).collect()
    assert {r.query_id for r in got} == {1, 3} and sum(r.query_id == 1 for r in got) == 50
    none = AnnIndex(spark, str(tmp_path / "b"))
    none.build(spark.createDataFrame([], kind))
    assert none.search(q).count() == 0


def test_providers(spark):
    texts = spark.createDataFrame([("a",), (None,)], "content string")
    assert [len(r.vector) for r in vectors.embed_by(texts, "Hash").collect()] == [64, 64]
    vectors.register_provider("short", lambda t: np.ones((len(t), 3)), 4)
    for bad in (lambda: vectors.embed_by(texts, "short").collect(), lambda: vectors.embed_by(texts, "none"), lambda: vectors.register_provider("SHORT", len, 3), lambda: vectors.embed_chunks(texts, lambda t: np.full((len(t), 2), np.nan)).collect()):
        with pytest.raises(Exception, match="shape|unknown|taken|finite"):
            bad()
