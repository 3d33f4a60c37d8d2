"""The dealt operators against brute force, and on nulls, empty texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lorewell.llm import bpe, brown_lm, chat, edit_embedding, entry, exact_dedup, licenses, mixing, quality, revisits, simhash

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "a", 0), (2, "", "a", 0), (3, "Same Text here", None, 1), (4, "same text HERE", "b", 2), (4, "same text HERE", "b", 2), (None, "cc by " * 3, "b", 3), (6, "word " * 5000, "c", 4)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string, size int").selectExpr("*", "1 as row", "2 as score", "3 as n")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in entry.oracle_sql().items():
        df, got = entry.queries()[name](spark, SF), con.execute(sql)
        columns = [d[0] for d in got.description]
        assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(got.fetchall(), key=repr), name


def test_quality(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.score_documents(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert quality.score_documents(odd, labels).count() == len(ODD)
    assert {r.score for r in quality.score_documents(odd, labels.limit(0)).collect()} == {0.5}
    rng = np.random.RandomState(1)
    good, bad = rng.normal(1, 1, (3000, quality.FEATURES)), rng.normal(-1, 1, (1000, quality.FEATURES))
    model = quality.fit(good[:1000], np.vstack([good[1000:], bad]))
    assert model.prior == pytest.approx(2 / 3, abs=0.1)  # the share of good rows among the unlabelled
    assert (model.score(good) >= 0.5).mean() > 0.95 and (model.score(bad) < 0.5).mean() > 0.95


def test_exact_dedup(odd):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(odd).collect()}
    assert got == {(1, 2, 2, False), (2, 2, 2, True), (3, 4, 3, False), (4, 4, 3, True), (None, None, 1, True), (6, 6, 1, True)}
    assert exact_dedup.exact_duplicates(odd.limit(0)).count() == 0


def test_edit_fingerprints(docs, odd):
    text = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(text, reverse=True)
    got = {r.doc_id: r for r in edit_embedding.fingerprints(docs).collect()}
    for k, i in enumerate(order):
        t, after = text[i], text[order[(k + 1) % len(order)]]
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (edit_embedding.fingerprint(t), edit_embedding.fingerprint(edited))
        assert r.near_next == edit_embedding.likeness(r.fingerprint, edit_embedding.fingerprint(after))
    assert np.mean([r.near_edited for r in got.values()]) > 0.6 > 0.3 > np.mean([r.near_next for r in got.values()])
    assert edit_embedding.fingerprints(odd).count() == len(ODD) and edit_embedding.fingerprints(odd.limit(0)).count() == 0


def test_brown_lm(docs, odd):
    out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    said = {r.doc_id: [*r.text.encode().lower().split(), 0] for r in docs.collect()}
    c = collections.Counter(w for i, ws in said.items() if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    rows = brown_lm.score_documents(docs).collect()
    for r in rows:
        ws = said[r.doc_id]
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(ws), sum(c[w] > 0 for w in ws), n)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
    assert brown_lm.score_documents(odd).count() == len(ODD)


def brute_simhash(t):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, odd):
    fp = {r.doc_id: brute_simhash(r.text) for r in docs.collect()}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(fp):
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert all(r.fingerprint == f"{fp[r.doc_id]:016x}" and r.component_id == find(r.doc_id) for r in simhash.near_duplicates(docs).collect())
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == len(ODD) and (1, "0" * 16, 1) in got and (2, "0" * 16, 1) in got


def test_links_lose_nothing(spark):
    rng = np.random.RandomState(1)
    base = rng.randint(0, 1 << 62, 50).tolist()
    fps = {b ^ sum(1 << int(k) for k in rng.choice(63, rng.randint(0, 4), replace=False)) for b in base for _ in range(8)}
    got = {frozenset(r) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}


def test_mixing(spark, docs, odd, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 10_000)
    got = mixing.op6(spark, SF).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes, taken, goal, shard = collections.Counter(), collections.Counter(), {}, collections.Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        goal[r.source] = r.target
        shard.update({k: r.size for k in r.shards})
        assert r.taken == len(r.shards) * r.size and len(r.shards) <= 3
    left, want = float(sum(sizes.values())), {s: 0.0 for s in sizes}
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(sizes))}
    free = set(sizes)
    while free and left > 1e-6:
        each = left / sum(weight[s] for s in free)
        for s in free:
            want[s] += each * weight[s]
        left = sum(max(0.0, want[s] - 3 * sizes[s]) for s in free)
        want = {s: min(x, 3.0 * sizes[s]) for s, x in want.items()}
        free = {s for s in free if want[s] < 3 * sizes[s]}
    assert goal == pytest.approx(want)
    assert len(shard) > 1
    largest = {s: max(r.size for r in got if r.source == s) for s in sizes}
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in sizes)
    mixed = mixing.mixed_documents(docs)
    rows = mixed.withColumn("part", mixing.F.spark_partition_id()).collect()
    assert mixed.columns == docs.columns
    assert collections.Counter((r.doc_id, r.part) for r in rows) == collections.Counter((r.doc_id, k) for r in got for k in r.shards)
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(odd.limit(0)).count() == 0


def test_mixing_misses_little(spark):
    got = mixing.op6(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    taken, goal = collections.Counter(), {r.source: r.target for r in got}
    for r in got:
        taken[r.source] += r.taken
    assert max(abs(taken[s] - goal[s]) / goal[s] for s in goal) < 0.02


def test_split_quotas_are_exact_and_disjoint(spark):
    quota = {"a": 70, "b": 5, None: 1, "c": 24}
    rows = mixing.split_quotas(spark.createDataFrame(list(quota.items()), "source string, quota long"), 3).collect()
    for s, q in quota.items():
        runs = sorted((r.start, r.blocks) for r in rows if r.source == s)
        assert sum(n for _, n in runs) == q and all(a + n == b for (a, n), (b, _) in zip(runs, runs[1:], strict=False)) and runs[0][0] == 0
    per = collections.Counter()
    for r in rows:
        per[r.shard] += r.blocks
    assert max(per.values()) - min(per.values()) <= 1 and len(per) == 8


def test_hypergeometric_law(spark):
    kk, nn, n = 7, 20, 9
    us = [(i + 0.5) / 2000 for i in range(2000)]
    df = spark.createDataFrame([(u,) for u in us], "u double")
    long = lambda x: mixing.F.lit(x).cast("long")
    got = collections.Counter(r.k for r in df.select(mixing.hypergeometric(long(kk), long(nn), long(n), mixing.F.col("u")).alias("k")).collect())
    for k in range(kk + 1):
        want = math.comb(kk, k) * math.comb(nn - kk, n - k) / math.comb(nn, n)
        assert got[k] / 2000 == pytest.approx(want, abs=0.001)


def test_bpe(docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary())
    for r, x in zip(bpe.encode_documents(docs, bpe.vocabulary()).collect(), docs.collect(), strict=True):
        ids = t.encode(x.text, add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    hard = ["", " ", "<|endoftext|>a <|startoftext|>", "\x1c\x1d a\x1fb\u0085c", "ΑΣ İ Straße", "it's WE'RE", "é", "🎉👩‍👩‍👧", "日本語", "½Ⅷ١", "a" * 3000, "\0 A\0"]
    for s, (ids, decoded) in zip(hard, bpe.WordBpe(bpe.vocabulary()).encode(hard), strict=True):
        want = t.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded == t.decode(want, skip_special_tokens=False)
    assert bpe.encoding_digests(odd, bpe.vocabulary()).count() == len(ODD)


def test_bpe_worker_holds_little(monkeypatch):
    """Frequent words outlive the others in a worker's memory, which stays within two generations and a chunk; long texts are
    worked on a few at a time."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "CHARACTERS", 500)
    t, mine, coded = Tokenizer.from_file(bpe.vocabulary()), bpe.WordBpe(bpe.vocabulary()), []
    encode_words = mine.encode_words
    mine.encode_words = lambda words: coded.extend(words) or encode_words(words)
    texts = [" ".join(["often", *(f"w{i}x{j}" for j in range(20))]) for i in range(40)] + ["long " * 300, None, ""]
    batch, rows = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts}), 0
    for ids, decoded, at in bpe._chunks(mine, batch):
        assert at == rows and len(ids) <= 5 and len(mine.known) + len(mine.older) < 400
        for x, y, text in zip(ids, decoded, texts[at:], strict=False):
            want = t.encode(text or "", add_special_tokens=False).ids
            assert np.frombuffer(x, "<u4").tolist() == want and y == t.decode(want, skip_special_tokens=False)
        rows += len(ids)
    assert rows == len(texts) and coded.count("often") == 1
    mine.forget()
    assert not mine.known and not mine.older


def test_licenses(docs, odd):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in licenses.scan_licenses(docs).collect():
        w = word.findall(text[r.doc_id].encode().lower().decode())
        at = [(i, label) for p, label in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(i for i, _ in at)) if at else (None, None))
    got = licenses.scan_licenses(odd).collect()
    assert len(got) == len(ODD) and next(r for r in got if r.doc_id is None).n_base == 3


def test_chat(spark):
    rows = [(1, 0, "user", "<turn|x>\n\\l"), (1, 1, "user", None), (1, 2, "assistant", "<end>\n\\b\\"), (1, 3, None, "x"), (1, 3, "assistant", ""), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(df).selectExpr("*").withColumn("turns", chat.read_turns(chat.F.col("formatted"))).withColumn("said", chat.loss_text(chat.F.col("formatted"), chat.F.col("loss"))).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("user", "<turn|x>\n\\l"), ("user", ""), ("assistant", "<end>\n\\b\\"), ("", "x"), ("assistant", "")]
    assert out[1].said == "<end>\n\\b\\" and len(out) == 2


def test_brown_gains_are_exact():
    """The gain of a move against the likelihood worked out anew, for words in the counts and for words that join."""
    rng, k, v = np.random.RandomState(0), 6, 20
    pairs, lab = rng.poisson(1.0, (v, v)).astype(float), rng.randint(0, 5, v)
    lab[0] = k - 1

    def seen(labels):
        out = np.zeros((k, k))
        np.add.at(out, (labels[:, None].repeat(v, 1), labels[None, :].repeat(v, 0)), pairs)
        return out

    s = seen(lab)
    for w in range(1, v):
        other = np.arange(v) != w
        left, right, own = np.bincount(lab, np.where(other, pairs[:, w], 0), k), np.bincount(lab, np.where(other, pairs[w], 0), k), pairs[w, w]
        moved = brown_lm.gains_of_moves(left[None], right[None], np.array([own]), lab[w : w + 1], s)[0]
        without = s.copy()
        without[:, lab[w]] -= left
        without[lab[w]] -= right
        without[lab[w], lab[w]] -= own
        joins = brown_lm.gains(left[None], right[None], np.array([own]), without)[0]
        then = [brown_lm.likelihood(seen(np.where(other, lab, c))) for c in range(k - 1)]
        for gain in [moved, joins] + ([brown_lm.gain_of_one(without)(left[None], right[None])[0]] if own == 0 else []):
            assert np.allclose(np.diff(gain[: k - 1]), np.diff(then))


def test_brown_scores_by_brute_force(docs, spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "HELD", 300)
    monkeypatch.setattr(brown_lm, "LEAST", 2)
    monkeypatch.setattr(brown_lm, "TOKENS", 5000)
    monkeypatch.setattr(brown_lm, "DISTINCT", 1000)
    m = brown_lm.Brown(docs)
    assert len(m.likelihoods) > 2 and all(a <= b for a, b in zip(m.likelihoods, m.likelihoods[1:], strict=False)) and m.likelihoods[-1] > m.likelihoods[0]
    label = dict(zip(m.held, m.labels.tolist(), strict=True)) | {bytes(r.w): r.k for r in m.rare.collect()}
    train = {r.doc_id: [b"", *brown_lm.tokens(r.text), b""] for r in docs.collect()}
    kept = [t for i, t in train.items() if zlib.crc32(str(i).encode()) % 10]
    n = collections.Counter(w for t in kept for w in t[1:])
    assert set(label) == set(n)
    seen, n_k, v_k = np.zeros((m.k, m.k)), np.zeros(m.k), np.zeros(m.k)
    for t in kept:
        for a, b in zip(t, t[1:], strict=False):
            seen[label[a], label[b]] += 1
    for w, c in n.items():
        n_k[label[w]], v_k[label[w]] = n_k[label[w]] + c, v_k[label[w]] + 1
    assert (seen == m.seen).all()
    move, out = (seen + 0.5) / (seen.sum(axis=1, keepdims=True) + 0.5 * m.k), 1 / (n_k + 0.1 * (v_k + 1))
    monkeypatch.setattr(brown_lm, "Brown", lambda _: m)
    for r in brown_lm.score_documents(docs).collect():
        t, total = train[r.doc_id], 0.0
        at = np.eye(m.k)[label[b""]]
        for w in t[1:]:
            one = np.eye(m.k)[label[w]] if w in n else np.ones(m.k)
            at = (at @ move) * out * one * (n[w] + 0.1)
            total += math.log10(at.sum())
            at = at / at.sum()
        assert r.score == pytest.approx(total)


def test_licenses_by_brute_force(spark, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def brute(text):
        w, labels, best = word.findall((text or "").encode().lower().decode()), set(), 0.0
        for words, label, must, base in licenses.templates():
            m, k, diagonals, spans = len(words), licenses.gram_of(len(words)), {}, []
            for i in range(len(w) - k + 1):
                for j in range(m - k + 1):
                    if w[i] == words[j] and w[i : i + k] == words[j : j + k]:
                        diagonals.setdefault(i - j, set()).update(range(j, j + k))
            for d in sorted(diagonals):
                if spans and m >= licenses.LONG and d - spans[-1][0] <= licenses.BAND:
                    spans[-1] = (d, spans[-1][1] | diagonals[d])
                else:
                    spans.append((d, diagonals[d]))
            for _, met in spans:
                if len(met) / m >= licenses.needed(m) and must <= met:
                    labels, best = labels | {label}, max(best, len(met) / m)
        return ",".join(sorted(labels)), best

    loose = "Permission is hereby granted, free of charge, to any good person obtaining one copy of this software and its associated documentation files (the Software), to deal in the Software without any restriction, including without limitation rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    some = [("Licensed under the MIT License", "mit"), ("Apache License, Version 2.0", "apache-2.0"), ("CC BY 3.0", "cc-by,cc-by-3.0"), ("CC BY-NC-SA 4.0.", "cc-by,cc-by-nc-sa-4.0"), ("GNU General Public License, version 3", "gpl,gpl-3.0"), (loose, "mit"), (None, ""), ("mit " * 9, "")]
    given = docs.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, (t, _) in enumerate(some)], "doc_id long, text string"))
    text = {r.doc_id: r.text for r in given.collect()}
    for r in licenses.scan_licenses(given).collect():
        want = brute(text[r.doc_id])
        assert r.labels == want[0] and r.score == pytest.approx(want[1])
        assert r.doc_id < 10**6 or r.labels == some[r.doc_id - 10**6][1]


def test_near_classes_against_all_pairs(spark, docs):
    rnd = np.random.RandomState(3)
    base = [r.text for r in docs.filter("length(text) > 400").limit(40).collect()]
    rows = list(enumerate(base))
    for i, t in enumerate(base):
        for k, rate in enumerate((400, 1000, 200)):
            u = list(t)
            for _ in range(max(1, len(u) // rate)):
                u[rnd.randint(len(u))] = "abcdefgh"[rnd.randint(8)]
            rows.append((1000 + 3 * i + k, "".join(u)))
    rows += [(5000 + i, base[0][: len(base[0]) - i - 1]) for i in range(60)] + [(9000, None), (9001, ""), (None, ""), (None, base[1]), (9002, "a"), (9003, "a"), (9003, "a")]
    prints = edit_embedding.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    got = edit_embedding.near_documents(prints).collect()
    assert len(got) == len(rows) and edit_embedding.near_documents(prints.limit(0)).count() == 0
    fps, met, found, linked = sorted({r.fingerprint for r in got}), 0, 0, {}
    of = {r.fingerprint: r.class_id for r in got}
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if edit_embedding.likeness(a, b) >= 0.8:
                met, found = met + 1, found + (of[a] == of[b])
                if any(a[k : k + edit_embedding.PER_BAND] == b[k : k + edit_embedding.PER_BAND] for k in range(0, edit_embedding.SLOTS, edit_embedding.PER_BAND)):
                    assert of[a] == of[b]
                    linked.setdefault(a, set()).add(b)
                    linked.setdefault(b, set()).add(a)
    for a in fps:  # and no class holds more than what those links reach
        reached, at = {a}, [a]
        while at:
            new = linked.get(at.pop(), set()) - reached
            reached |= new
            at += new
        assert {b for b in fps if of[b] == of[a]} == reached
    assert met > 100 and found >= 0.9 * met
    ids = {r.doc_id: r.class_id for r in got}
    assert ids[9002] == ids[9003] == 9002 and ids[9000] == ids[9001] == 9000


def test_revisits(spark, monkeypatch):
    monkeypatch.setattr(revisits, "SPAN_RECORDS", 3)
    h = {"Date": "1", "ETag": "x", "Keep": "k"}
    rows = [(1, "http://a.b/", 10, "response", '"t"', None, h), (2, "https://www.a.b", 10, "response", '"u"', "d1", h), (3, "http://a.b:80", 10, "revisit", '"t"', None, None), (4, "http://a.b", 11, "revisit", 'W/"u"', None, {"date": "2", "X": "y"}),
            (5, "http://a.b", 12, "revisit", None, "d2", {}), (5, "http://a.b", 12, "revisit", None, "d2", {}), (6, "http://a.b", 13, "revisit", None, None, {"DATE": "3"}), (7, None, 5, "revisit", None, None, None), (8, "http://a.b", None, "revisit", None, None, None),
            (9, "a.b", 20, "revisit", None, None, None), (10, "c.d", 1, "response", None, None, h), (11, "http://A.b/x", 99, "revisit", None, None, None), (None, None, None, "response", None, None, None)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>").withColumn("span", revisits.F.lit(1)).withColumn("status", revisits.F.lit(1))
    got = {(r.record_id, r.response_id, r.status) for r in revisits.resolve_revisits(df).collect()}
    assert got == {(3, None, "orphan"), (4, 2, "resolved"), (5, None, "mismatch"), (6, 2, "unchecked"), (7, None, "orphan"), (8, None, "orphan"), (9, None, "orphan"), (11, None, "orphan")}
    four = next(r for r in revisits.resolve_revisits(df).collect() if r.record_id == 4)
    assert four.headers == {"date": "2", "etag": "x", "keep": "k"} and revisits.resolve_revisits(df).count() == 9 and revisits.resolve_revisits(df.limit(0)).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(none, bpe.vocabulary()).count() == 0 and brown_lm.score_documents(none).count() == 0 and licenses.scan_licenses(none).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert exact_dedup.without_duplicates(none).count() == 0 and simhash.without_near_duplicates(none).count() == 0


def test_stages_with_clashing_names(spark):
    names = "key part rules places passes target n_blocks source_size block low high chosen cells id tie all row fp place salt maybe size gid digit rest".split()
    df = spark.createDataFrame([(1, "some words here", "a", 1), (2, None, None, 2), (None, "x y", "b", 3)], "doc_id long, text string, source string, n int").select("*", *[quality.F.lit(1).alias(n) for n in names])
    for stage in (exact_dedup.without_duplicates, simhash.without_near_duplicates, mixing.mixed_documents):
        out = stage(df)
        assert out.columns == df.columns and out.count() >= 2


def test_encode_stage_returns_tokens_and_text(docs, spark):
    import corpus_pipeline

    got = {r.doc_id: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    digests = bpe.op8(spark, SF).collect()
    assert len(digests) == len(got) and all(r.n_tokens == len(got[r.doc_id].ids) == got[r.doc_id].n_tokens for r in digests)
    for r in digests:
        assert (r.ids_sha256, r.decoded_sha256) == (sha(np.array(got[r.doc_id].ids, "<u4").tobytes()), sha(got[r.doc_id].decoded.encode()))


def test_dedup_stages_keep_one_row_of_each_class(spark, docs):
    rows = [(1, "Same Text", "a"), (2, "same text", "a"), (2, "SAME text", "b"), (2, "same text", "a"), (2, "same text", "b"), (None, "only null ids here", "a"), (None, "only null ids here", "a"), (None, "ONLY null ids here", "c"),
            (3, "alone", "a"), (None, "alone with null", "a"), (2, "another text of id two", "a"), (1, "another TEXT of id two", "a"), (4, None, "a"), (4, "", "a")]
    given = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("m", exact_dedup.F.create_map("row", "row"))
    low = lambda r: (r.text or "").lower()
    for stage, pick in ((exact_dedup.without_duplicates, max), (simhash.without_near_duplicates, min)):
        got = stage(given).collect()
        want = {t: pick([i for i, x, _ in rows if (x or "").lower() == t and i is not None], default=None) for t in {(x or "").lower() for _, x, _ in rows}}
        assert sorted((low(r), r.doc_id) for r in got) == sorted(want.items()) and stage(given).columns == given.columns
        assert sorted(map(repr, stage(given.repartition(5)).collect())) == sorted(map(repr, got))
        once = collections.Counter(r.doc_id for r in stage(docs).collect())
        assert once == collections.Counter(r.doc_id for r in stage(docs.union(docs)).collect()) and set(once.values()) == {1}
