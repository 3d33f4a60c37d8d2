"""What the operators hand from task to task, and that they do so in few steps."""

import collections
import sys
import zlib

import numpy as np
import pytest
from lorewell.llm import bpe, brown_lm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_brown_pairs_are_handed_on_by_slice(docs, monkeypatch):
    """Pairs leave a task as packed numbers, a row a slice and side, and add up to the pairs counted by hand."""
    texts = [["", *(r.text or "").encode().lower().split(), ""] for r in docs.collect()]
    texts = [[w or b"" for w in t] for t in texts]
    held = [b"", *(w for w, _ in collections.Counter(w for t in texts for w in t if w).most_common(700))]
    at, want = {w: i for i, w in enumerate(held)}, collections.Counter()
    for t in texts:
        want.update((at[x], at[y]) for x, y in zip(t, t[1:], strict=False) if x in at and y in at)
    monkeypatch.setattr(brown_lm, "TOKENS", 1 << 14)  # so that a task hands on several parts, and adds up some at a time
    pairs = brown_lm.count_pairs(docs.repartition(3), held)
    assert pairs.count() <= 2 * brown_lm.SLICES * (sum(len(t) + 1 for t in texts) // (1 << 14) + 3)
    for side in "rl":
        got = {}
        for r in brown_lm.slices_of(pairs, len(held)).select("slice", side).collect():
            w, v, n = (np.frombuffer(x, kind).tolist() for x, kind in zip(r[side] or (b"",) * 3, ("<i4", "<i4", "<i8"), strict=True))
            got |= {((x * brown_lm.SLICES + r.slice, y) if side == "r" else (y, x * brown_lm.SLICES + r.slice)): z for x, y, z in zip(w, v, n, strict=True)}
        assert got == want


def test_brown_places_are_dealt_by_word_once(spark, monkeypatch):
    """One shuffle gives every place its word's class, also where a word's places fill many blocks or are unseen in training."""
    rng, k = np.random.RandomState(0), 5
    seen = rng.randint(1, 50, (k, k)).astype(float)
    word = lambda i: b"w%d" % i
    rows, places = [], []
    for uid in range(60):
        out, rare = zlib.crc32(str(uid).encode()) % 3 == 0, []
        for pos in range(rng.randint(0, 30)):
            i = int(rng.choice([0, rng.randint(1, 8), rng.randint(8, 400)])) if rng.rand() < 0.8 or not out else 999
            rare.append((word(i), *(int(x) for x in rng.choice([*range(k), brown_lm._NONE], 2))))
            places.append((uid, pos, out, *rare[-1]))
        rows.append((uid, out, rare))
    read = spark.createDataFrame(rows, "uid long, held_out boolean, rare array<struct<w:binary,b:int,a:int>>")
    n, near = collections.Counter(p[3] for p in places if not p[2]), collections.defaultdict(lambda: np.zeros((2, k)))
    for _, _, out, w, *beside in places:
        for side, c in enumerate(beside):
            if not out and c != brown_lm._NONE:
                near[w][side, c] += 1
    label = {w: (int(brown_lm.gains(*near[w][:, None], np.zeros(1), seen)[0, : k - 1].argmax()) if w in near else k) for w in n}
    for at_once in (1, 7, 1 << 16):
        monkeypatch.setattr(brown_lm, "PLACES", at_once)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(at_once, 10_000))
        try:
            got = brown_lm.place_rare(read, seen)
            found = got.collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {(r.uid, r.pos): (r.n, r.k) for r in found} == {(u, p): (n[w], label.get(w, brown_lm._NONE)) for u, p, _, w, *_ in places} and len(found) == len(places)
        assert sorted((bytes(r.w), r.n, r.k) for r in found if r.w is not None) == sorted((w, c, label[w]) for w, c in n.items())
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1


def test_brown_places_left_over_at_a_task_end(spark, monkeypatch):
    """The places that a task keeps after its last full block are a slice of a batch; they come out as all others do."""
    words = [0, 0, 0, 1, 2, 2, 2, 2, 3, 3, 4, 4, 4, 4, 4, 5, 5]  # of each row, all in training texts
    rare = f"transform(array{tuple(words)}, i -> named_struct('w', encode(concat(id, ' ', i), 'UTF-8'), 'b', 0, 'a', 1))"
    for rows, sizes in ((4200, [brown_lm.PLACES]), (1, range(1, len(words) + 2))):
        read = spark.range(rows).selectExpr("id as uid", "false as held_out", f"{rare} as rare")
        want = {b"%d %d" % (uid, i): words.count(i) for uid in range(rows) for i in words}
        for places in sizes:
            monkeypatch.setattr(brown_lm, "PLACES", places)
            changed = {"spark.sql.shuffle.partitions": 1, "spark.sql.execution.arrow.maxRecordsPerBatch": places if rows == 1 else rows * len(words)}
            before = {c: spark.conf.get(c) for c in changed}
            for c, value in changed.items():
                spark.conf.set(c, value)
            try:
                found = brown_lm.place_rare(read, np.ones((5, 5))).collect()
            finally:
                for c, value in before.items():
                    spark.conf.set(c, value)
            assert len(found) == rows * len(words) and {bytes(r.w): r.n for r in found if r.w is not None} == want


def test_bpe_words_of_all_lengths(monkeypatch):
    """Short words are merged together, long ones each by lists of positions, with the library's tokens; short ones in far
    less time than a step of the interpreter for each of their letters takes."""
    from tokenizers import Tokenizer

    rng, library, mine = np.random.RandomState(0), Tokenizer.from_file(bpe.vocabulary()), bpe.WordBpe(bpe.vocabulary())
    words = ["".join(rng.choice(list("aaaabbeinorst"), n)) for n in [*range(1, 140), 5000] for _ in range(3)] + ["a" * n for n in range(1, 90)] + ["ß" * 31, "ß" * 33, "é", "日本" * 40, "!" * 70, "7"]
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    for long in (0, 1, 64, 1 << 30):
        monkeypatch.setattr(bpe, "LONG", long)
        got = mine.encode_words(words)
        assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in got] == want and [x for _, x in got] == [library.decode(ids, skip_special_tokens=False) for ids in want]
    assert mine.encode_words([]) == []
    monkeypatch.setattr(bpe, "LONG", 64)
    steps, many = [0], list({"".join(rng.choice(list("aeinorst"), 9)) for _ in range(5000)})

    def count(*_):
        steps[0] += 1
        return count

    sys.settrace(count)
    try:
        mine.encode_words(many)
    finally:
        sys.settrace(None)
    assert steps[0] < 9 * len(many)
