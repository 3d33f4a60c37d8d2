"""Fill-in-middle, repeated passages and importance resampling against brute force, and on odd rows."""

import hashlib
import math
import random
import tracemalloc
import re
import zlib

import numpy as np
import pytest
from lorewell.llm import edit_embedding, fim, mixing, resampling, revisits, suffix_dedup
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
ODD = [(1, None, "a", 0), (2, "", "a", 0), (3, "Same Text here", None, 1), (4, "same text HERE", "b", 2), (4, "same text HERE", "b", 2), (None, "cc by " * 30, "b", 3), (6, "word " * 120_000, "c", 4), (7, " \n", "c", 4), (8, "a <M> b", "c", 4)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string, size int").selectExpr("*", "1 as row", "2 as score", "3 as n", "4 as id", "5 as fp", "6 as lead", "7 as tie", "8 as part", "9 as h1", "'x' as output", "0 as start")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_boundaries_select_as_an_array_does():
    rng, seen = np.random.RandomState(0), set()
    for n, share in ((10, 0.5), (100_000, 0.5), (300_000, 0.01), (200_000, 0.99999), (70_000, 0.0)):
        offsets = np.flatnonzero(np.r_[True, rng.rand(n) < share])
        held = fim.Boundaries(offsets)
        seen |= {c[0] for c in held.containers}
        assert len(held) == len(offsets) and all(held.select(k) == offsets[k] for k in [0, len(offsets) - 1, *rng.randint(0, len(offsets), 200)])
    assert seen == {"array", "bitmap", "runs"}
    assert len(fim.Boundaries(np.zeros(0, np.int64))) == 0
    text = " a\n\n b\x1cc　 é \n"
    assert fim.ends_of(text).tolist() == [m.end() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)]
    assert fim.ends_of(text, "character").tolist() == list(range(1, len(text) + 1)) and fim.ends_of("a\n\nb", "line").tolist() == [2, 3, 4]


def fim_by_hand(id_, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return id_, len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return id_, len(units), form, len(p), len(m), out


def test_fill_in_middle(spark, docs, odd):
    for d in (docs, odd):
        rows = [(r.doc_id, r.text) for r in d.collect()]
        made = fim.fill_in_middle(d).withColumn("back", fim.restored(F.col("output"), F.col("form")))
        want = sorted(((*fim_by_hand(i, t), t or "") for i, t in rows), key=repr)
        assert sorted(map(tuple, made.collect()), key=repr) == want
    assert fim.fill_in_middle(odd.limit(0)).count() == 0
    every = fim.fill_in_middle(docs, rate=100, spm_rate=0, unit="character").withColumn("back", fim.restored(F.col("output"), F.col("form")))
    assert {r.form for r in every.select("form").distinct().collect()} <= {"psm", "plain"} and every.join(docs, "doc_id").filter("back <> text").count() == 0


def removed_by_hand(rows, length=50):
    least = {}
    key = lambda i: math.inf if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            least[s] = min(least.get(s, math.inf), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < key(i):
                gone[p + 1 : p + length + 1] = True
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])))
    return sorted(out, key=repr)


def test_multikey_quicksort():
    rng = np.random.RandomState(1)
    for n in (0, 1, 5, 9000):
        digits = rng.randint(0, 4, (3, n)).astype(np.uint64)
        got = digits[:, suffix_dedup.multikey_quicksort(digits)].T.tolist()
        assert got == sorted(digits.T.tolist())


def test_every_string_has_the_anchor_of_its_bytes():
    """Each string lies in one piece, and equal strings have equal anchors wherever they stand."""
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 49, 50, 51, 300]))) for _ in range(40)] + [b"x" * 200]
    seen = {}
    for owner, base, data, ends in suffix_dedup.spans(texts, 50):
        begins = np.r_[0, ends[:-1]]
        start, count, anchor, _ = suffix_dedup.pieces(data, ends, 50)
        covered = set()
        for s, c, a in zip(start, count, anchor, strict=True):
            assert c <= 31
            for p in range(s, s + c):
                string = bytes(data[p : p + 50])
                covered.add(p)
                assert seen.setdefault(string, bytes(data[a : a + 20])) == bytes(data[a : a + 20]) and bytes(data[a : a + 20]) in string
        assert covered == {p for b, e in zip(begins, ends, strict=True) for p in range(b, e - 49)}


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup(spark, docs, monkeypatch, small):
    if small:  # many buckets, blocks and spans, and anchors of more pieces than one task compares
        for name, value in {"BUCKET": 40, "SPAN": 300, "BLOCK": 2000, "SMALL": 8, "MANY": 4}.items():
            monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(3)
    base = ["".join(rng.choice("abc é") for _ in range(rng.choice([40, 60, 90, 200, 400]))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(base)[rng.randrange(30) : rng.randrange(30, 400)] for _ in range(rng.randrange(5)))) for i in range(120)]
    rows += [(200 + i, "-" * rng.randrange(200)) for i in range(20)] + [(300 + i, ("ab" * 50)[: rng.randrange(100)] * 3) for i in range(20)]
    rows += [(5, base[0]), (5, base[0] + "x"), (None, base[1]), (None, base[1] + base[2]), (900, None), (900, "")]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = lambda d: sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.without_repeats(d).collect()), key=repr)
    assert out(made) == removed_by_hand(rows)
    if not small:
        assert out(docs) == removed_by_hand([(r.doc_id, r.text) for r in docs.collect()])


def test_suffix_dedup_holds_few_places_at_once():
    """Comparing pieces and picking out strings takes a few times the pieces' bytes, not eight bytes for each of them."""
    rng = np.random.RandomState(4)
    lead = rng.randint(97, 99, (30_000, suffix_dedup._width(50))).astype(np.uint8)
    lead[:, :20], lead[:, -2], lead[:, -1] = 120, 30, 80
    anchor, full = np.zeros(len(lead), np.int64), np.full(4000, 100)

    def peak(f, *args):
        tracemalloc.start()
        out = f(*args)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    (before, behind), most = peak(suffix_dedup._reach, lead, anchor, 50)
    assert most < 10 * lead.nbytes
    for i in rng.randint(0, len(lead), 5):
        text = lambda r: bytes(r[50:80]) + bytes(r[:50])
        same = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y, strict=True)) if p != q), len(x))
        others = [text(r) for r in np.delete(lead, i, axis=0)]
        mine = text(lead[i])
        assert before[i] == max(same(mine[29::-1], o[29::-1]) for o in others) and behind[i] == max(same(mine[30:], o[30:]) for o in others)
    (string, piece, at), most = peak(suffix_dedup._strings, lead[:4000], full, full, 50)
    assert len(string) == 31 * 4000 and most < 10 * string.nbytes
    assert all(bytes(string[k]) == text(lead[piece[k]])[at[k] : at[k] + 50] for k in range(0, len(string), 997))


def test_suffix_dedup_on_odd_rows(odd):
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.without_repeats(odd).collect()}
    assert got == {(1, 0, 0, 0), (2, 0, 0, 0), (3, 14, 0, 0), (4, 14, 0, 0), (None, 180, 0, 0), (6, 600_000, 0, 0), (7, 2, 0, 0), (8, 7, 0, 0)}
    assert suffix_dedup.without_repeats(odd).count() == len(ODD) and suffix_dedup.without_repeats(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.without_repeats(odd, 20)


def buckets_by_hand(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


@pytest.mark.parametrize("block", [1, 2, 3, 5, 1 << 17])
def test_crcs_from_two_prefixes(monkeypatch, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(40):
        text = " ".join(rng.choice(["Ab", "é", "x" * rng.choice([1, 63, 64, 255, 256, 257, 5000]), "2,d", "-", "Ünï"]) for _ in range(rng.randrange(12)))
        got = list(resampling.gram_buckets(text))
        want, n = buckets_by_hand(text)
        assert sorted(int(x) for g, _ in got for x in g) == sorted(want) and sum(c for _, c in got) == n
    assert list(resampling.gram_buckets(None)) == []


def resampled_by_hand(docs, target):
    s, t = np.zeros(10_000), np.zeros(10_000)
    for into, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            np.add.at(into, buckets_by_hand(text)[0], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        found, n = buckets_by_hand(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for place, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_resampling(spark, docs, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    target = [r.text for r in bench.collect()]
    got = sorted(map(tuple, resampling.resample(docs, bench).collect()), key=repr)
    assert got == resampled_by_hand([(r.doc_id, r.text) for r in docs.collect()], target) and sum(r[4] is not None for r in got) > 5
    more = odd.unionByName(odd.limit(3)).unionByName(odd.filter("doc_id is null"))
    rows = [(r.doc_id, r.text) for r in more.collect()]
    assert sorted(map(tuple, resampling.resample(more, bench.limit(0)).collect()), key=repr) == resampled_by_hand(rows, [])
    assert resampling.resample(odd.limit(0), bench).count() == 0
    half = resampling.resample(odd, bench, share=100, least_words=1)
    assert sorted(r.rank for r in half.collect() if r["rank"] is not None) == [1, 2, 3, 4, 5, 6]


def test_mixing_of_a_source_of_empty_texts(spark):
    rows = [(i, "a" if i % 20 else "b", None if i % 3 else "") for i in range(6000)] + [(10_000 + i, "a", "w " * (1 + i % 90)) for i in range(60)] + [(20_000 + i, "b", "w " * 50) for i in range(400)]
    made = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = made.select("source", mixing.key_of().alias("key"), mixing.size_of().alias("size"))
    assert all(len(r.chosen or []) <= 460 for r in mixing.mixing_plan(sized)[0].collect())
    got, want = (mixing.mix(d).join(made.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).orderBy("source").collect() for d in (made, made.filter("text > ''")))
    assert [(r.source, r.target) for r in got] == [(r.source, r.target) for r in want]
    assert all(abs(r.taken - r.target) <= 90 for r in [*got, *want])
    assert mixing.mixed_documents(made).filter("text > ''").count() > 0


@pytest.mark.parametrize("seed", range(3))
def test_revisits_of_one_time_and_one_url(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        hot = rng.random() < 0.4
        kind = "response" if rng.random() < 0.5 else "revisit"
        rows.append((i, "http://hot.example/" if hot else f"http://h{rng.randrange(9)}.example/", 500 if rng.random() < 0.4 else rng.randrange(0, 1000, 50), kind))
    made = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string").selectExpr("*", "cast(null as string) etag", "cast(null as string) last_modified", "cast(null as map<string,string>) headers")
    got = {r.record_id: r.response_id for r in revisits.resolve_revisits(made).collect()}
    want = {i: max(((t, j) for j, v, t, k2 in rows if v == u and t < ts and k2 == "response"), default=(None, None))[1] for i, u, ts, k in rows if k == "revisit"}
    assert got == want


def test_fingerprints_are_places_of_the_whole_embedding():
    """The embedding written out in full: each character is said as often as its class stays at that time."""
    stay, records, _ = edit_embedding._walk()
    rng = random.Random(4)
    for text in ["", "a", "é" * 50, *["".join(rng.choice("abc dé日") for _ in range(rng.randrange(400))) for _ in range(30)]]:
        said = []
        for ch in text:
            c = (ord(ch) * 0x9E3779B1 >> 13) % edit_embedding.CLASSES
            said += [c] * stay[c][len(said) % edit_embedding.PERIOD]
        at = [max(p for p in own if p <= max(2 * len(text) - 1, 0)) for own in records]
        want = "".join("0123456789abcdefghijklmnopqrstuv"[said[p]] if p < len(said) else "-" for p in at)
        assert edit_embedding.fingerprint(text) == want
