"""The pipeline from end to end against each stage's own rule, and the risk that the classifier minimises."""

import collections
import math

import corpus_pipeline
import numpy as np
import pytest
from lorewell.llm import bpe, mixing, quality, simhash
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_run_is_its_stages(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in quality.score_documents(docs, labels).collect() if r.score >= 0.7}
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    largest = {}
    for i in sorted(text):
        largest[lower(text[i])] = i
    kept = sorted(largest.values())
    prints = {i: simhash.simhash(lower(text[i])) & (2**64 - 1) for i in kept}
    root = {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in kept:
        for b in kept:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    left = sorted({find(i) for i in kept})
    assert len(docs.collect()) > len(good) > len(kept) >= len(left) > 50
    staged = docs.filter(docs.doc_id.isin(left))
    times = {r.doc_id: len(r.shards) for r in mixing.mix(staged).collect()}

    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter({i: n for i, n in times.items() if n})
    library = Tokenizer.from_file(bpe.vocabulary())
    library.no_truncation()
    library.no_padding()
    for r in rows[::7]:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_good_documents_on_odd_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (None, "word " * 120_000), (9_000_001, ""), (9_000_001, "")], "doc_id long, text string")
    rows = docs.union(odd).selectExpr("*", "1 as score", "2 as key", "3 as trusted", "'v' as value", "4 as predicted")
    got = quality.good_documents(rows, labels)
    assert got.columns == rows.columns
    want = collections.Counter(r.doc_id for r in quality.score_documents(rows, labels).collect() if r.predicted)
    assert collections.Counter(r.doc_id for r in got.collect()) == want


def risk(model, p, u):
    """The non-negative unbiased risk, written out row by row."""
    loss = lambda z: math.log1p(math.exp(-z)) if z > -30 else -z
    g = lambda x: float(model.inputs(x[None])[0] @ model.w + model.b)
    as_positive = sum(loss(g(x)) for x in p) / len(p)
    negative = sum(loss(-g(x)) for x in u) / len(u) - model.prior * sum(loss(-g(x)) for x in p) / len(p)
    return model.prior * as_positive + max(0.0, negative), negative


@pytest.mark.parametrize("seed", range(2))
def test_the_fit_minimises_the_risk(seed):
    rng = np.random.RandomState(seed)
    good, bad = rng.normal(0.5, 1, (300, quality.FEATURES)), rng.normal(-0.5, 1, (120, quality.FEATURES))
    p, u = good[:100], np.vstack([good[100:], bad])
    model = quality.fit(p, u)
    best, negative = risk(model, p, u)
    assert negative > -0.05  # where it falls below zero the step is turned round, so it stays near zero
    for scale in (0.02, 0.1, 0.5):
        for _ in range(15):
            other = quality.Model(model.mean, model.scale, model.w + rng.normal(0, scale, model.w.shape), model.b + rng.normal(0, scale), model.prior)
            assert risk(other, p, u)[0] > best - 0.02
