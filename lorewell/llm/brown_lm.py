"""Language-model scores by Brown class-based bigrams."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, groupby, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.common import discard, fold_of, staged, table, text_of

#: Classes at least (beyond that the count of words to the power 0.3), sweeps of the exchange at most, additive smoothing
#: of words and of class transitions.
CLASSES, SWEEPS, ALPHA, BETA = 64, 6, 0.1, 0.5
#: About so many of the most frequent words, of those said LEAST times or more, are exchanged again and again; every other
#: counted word is placed once. (Words said once or twice fit any class, and exchanging them too makes unseen texts
#: likelier by less: at sf0.01 2 % instead of 6 %.)
HELD, LEAST = 65_536, 5
#: Parts that the exchanged words are dealt into; distinct words, and tokens, that a task counts before it hands them on;
#: places of other words that a task works on at once.
SLICES, DISTINCT, TOKENS, PLACES = 512, 300_000, 1 << 22, 1 << 16
END = b""
_NONE = 0xFFFF  # stands for the class of a word that isn't held


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def count_words(train: DataFrame) -> DataFrame:
    """(word, n) over all training texts; each text ends with one end token, the empty word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                seen.update(tokens(text.as_py()))
                seen[END] += 1
                if len(seen) >= DISTINCT:
                    yield _columns(word=pa.array(seen.keys(), pa.binary()), n=pa.array(seen.values(), pa.int64()))
                    seen = Counter()
        if seen:
            yield _columns(word=pa.array(seen.keys(), pa.binary()), n=pa.array(seen.values(), pa.int64()))
            seen.clear()
        _give_back()

    return train.select(text_of().alias("text")).mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _give_back() -> None:
    """At a task's end: the worker lives on, and other steps need its memory."""
    pa.default_memory_pool().release_unused()


def _columns(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def held_words(words: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """About HELD most frequent words and their counts, by falling count; the end token is always among them.

    A small histogram of the counts gives the count above which HELD words lie; of the words at that count a share is
    taken by hash. So no more rows than these meet in the driver."""
    step = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(F.log2("n") * 16)).cast("long")
    left, cut, share = HELD, 1, 1.0
    for r in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # about 2 000 steps at most
        cut, share = r.step, min(1.0, left / r["count"])
        left -= r["count"]
        if left <= 0:
            break
    few = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))
    often = (F.col("n") >= LEAST) & ((step > cut) | (step == cut) & few)
    rows = words.filter(often | (F.col("word") == F.lit(END))).collect()
    rows = sorted(((bytes(r.word), r.n) for r in rows), key=lambda x: (-x[1], x[0])) or [(END, 0)]
    return [w for w, _ in rows], np.array([n for _, n in rows], np.int64)


def _summed(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of at in order, and the sum of n over each."""
    order = np.argsort(at, kind="stable")
    at, n = at[order], n[order]
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return at[first], np.add.reduceat(n, first) if len(n) else n


def _places(words: Iterator[bytes], of: dict[bytes, int], count: int) -> np.ndarray:
    """The places of words in the list of held ones; -1: not held."""
    return np.fromiter(map(of.get, words, repeat(-1)), np.int32, count)


def count_pairs(train: DataFrame, held: list[bytes]) -> DataFrame:
    """(slice, after, at, n): how often which held words stand beside those of a slice (the words that are `slice` modulo
    SLICES), after them or before them; a text begins and ends with the end token. at: packed, ascending numbers
    (w // SLICES) * len(held) + v; n: packed counts over some of the texts, so the rows of a slice are to be added up."""
    shared, size = train.sparkSession.sparkContext.broadcast(held), len(held)
    wide = -(-size // SLICES) * size  # numbers of a slice; fewer than 2 ** 31 up to a million held words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {w: i for i, w in enumerate(shared.value)}
        edge, cut, said, length = of[END], np.array([of[END], -1], np.int32), [], 0  # nothing stands between two texts

        def summed() -> Iterator[pa.RecordBatch]:
            w = np.concatenate(said)
            said.clear()
            at = np.flatnonzero((w[:-1] >= 0) & (w[1:] >= 0)).astype(np.int32)
            code = w[at].astype(np.int64)
            code *= size
            code += w[at + 1]
            del w, at
            code.sort()
            first = np.flatnonzero(np.diff(code, prepend=-1))
            n, code = np.diff(first, append=len(code)).astype("<i4"), code[first]
            a, b = code // size, code % size
            del first, code
            for after, x, y in ((True, a, b), (False, b, a)):
                key = x % SLICES * wide + x // SLICES * size + y
                order = np.argsort(key)
                key, m = key[order], n[order]
                ends = np.searchsorted(key, np.arange(SLICES + 1) * wide)
                some = np.flatnonzero(np.diff(ends))
                key = (key % wide).astype("<i4")
                packed = lambda c: pa.array([c[ends[i] : ends[i + 1]].tobytes() for i in some], pa.binary())  # noqa: B023, E731
                yield _columns(slice=pa.array(some, pa.int32()), after=pa.array([after] * len(some)), at=packed(key), n=packed(m))

        for batch in batches:
            for text in batch.column(0):
                words = tokens(text.as_py())
                said += [np.array([edge], np.int32), _places(words, of, len(words)), cut]
                length += len(words) + 3
                if length >= TOKENS:
                    yield from summed()
                    length = 0
        if said:
            yield from summed()
        of.clear()
        _give_back()

    return train.select(text_of().alias("text")).mapInArrow(work, "slice int, after boolean, at binary, n binary")


def slices_of(pairs: DataFrame, held: int) -> DataFrame:
    """(slice, r, l): the rows of count_pairs() added up: the pairs of the words of a slice as packed w, v and n, with the
    words after them (r) and before them (l). At most HELD * HELD / SLICES of each in a row; a task adds up the rows of one
    slice and side after another, some TOKENS pairs beyond the distinct ones at once."""
    side = pa.struct([("w", pa.binary()), ("v", pa.binary()), ("n", pa.binary())])

    def packed(at: np.ndarray, n: np.ndarray) -> dict:
        return {"w": (at // held).astype("<i4").tobytes(), "v": (at % held).astype("<i4").tobytes(), "n": n.astype("<i8").tobytes()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(*(b.column(c) for c in range(4)), strict=True))
        for s, of_slice in groupby(rows, lambda x: x[0].as_py()):
            found = {True: None, False: None}
            for after, of_side in groupby(of_slice, lambda x: x[1].as_py()):
                ats, ns, waiting = [], [], 0
                for x in of_side:
                    ats.append(np.frombuffer(x[2].as_py(), "<i4"))
                    ns.append(np.frombuffer(x[3].as_py(), "<i4").astype(np.int64))
                    waiting += len(ats[-1])
                    if waiting >= TOKENS:
                        at, n = _summed(np.concatenate(ats), np.concatenate(ns))
                        ats, ns, waiting = [at], [n], 0
                found[after] = packed(*_summed(np.concatenate(ats), np.concatenate(ns)))
            yield _columns(slice=pa.array([s], pa.int32()), r=pa.array([found[True]], side), l=pa.array([found[False]], side))
        _give_back()

    kind = "struct<w:binary,v:binary,n:binary>"
    return pairs.repartition("slice").sortWithinPartitions("slice", "after").mapInArrow(work, f"slice int, r {kind}, l {kind}")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(seen: np.ndarray) -> float:
    """Of the class bigrams, but for a sum that doesn't depend on the classes."""
    return float(_xlogx(seen).sum() - _xlogx(seen.sum(axis=0)).sum() - _xlogx(seen.sum(axis=1)).sum())


def pair_gains(left: np.ndarray, right: np.ndarray, own: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """words x classes: the rise of the sum over class pairs as a word's pairs are added to a class. left and right (words x
    classes): how often each class stands before and after the word, itself not counted; own: how often it follows itself."""
    k, f, base = len(seen), _xlogx, _xlogx(seen)
    out, both = np.zeros(left.shape), np.arange(k)
    for near, rows, log in ((left, seen, base), (right, seen.T, base.T)):
        w, d = np.nonzero(near)
        n = near[w, d]
        for at in range(0, len(w), 1 << 12):
            part = slice(at, at + (1 << 12))
            more = f(rows[d[part]] + n[part, None]) - log[d[part]]
            more[np.arange(len(more)), d[part]] = 0.0  # pairs of the class with itself are counted below
            first = np.flatnonzero(np.diff(w[part], prepend=-1))
            out[w[part][first]] += np.add.reduceat(more, first, axis=0)
    return out + f(seen[both, both] + left + right + own[:, None]) - base[both, both]


def gains(left: np.ndarray, right: np.ndarray, own: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """words x classes: by how much likelihood() rises as a word joins a class, but for a sum that is the same for all
    classes (the word's neighbours are said more often, whatever its class). seen: class pairs without the word."""
    out, f = pair_gains(left, right, own, seen), _xlogx
    for near, other, total in ((right, left, seen.sum(axis=1)), (left, right, seen.sum(axis=0))):
        out -= f(total + other + (near.sum(axis=1) + own)[:, None]) - f(total + other)
    return out


def gains_of_moves(left: np.ndarray, right: np.ndarray, own: np.ndarray, mine: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """As gains(), for words that are counted in seen, each in its class `mine`: as if each alone were taken out first."""
    f, i = _xlogx, np.arange(len(mine))
    out = pair_gains(left, right, own, seen)
    stays = f(seen[mine, mine]) - f(seen[mine, mine] - left[i, mine] - right[i, mine] - own)
    for near, other, rows in ((left, right, seen), (right, left, seen.T)):
        # Pairs of another class with the word's own one: there the word's pairs of the other side are taken out.
        at = np.flatnonzero(near[i, mine] > 0)
        x, n, o = rows[mine[at]], near[at, mine[at]][:, None], other[at]
        out[at] += f(x - o + n) - f(x - o) - f(x + n) + f(x)
        total, said = rows.sum(axis=0), (near.sum(axis=1) + own)[:, None]  # left: how often a class comes second
        out -= f(total + said) - f(total)
        stays -= f(total[mine]) - f(total[mine] - said[:, 0])
        for cut in range(0, len(mine), 4096):
            p = slice(cut, cut + 4096)
            column = rows.T[mine[p]]
            rise = f(column) - f(column - near[p])
            rise[np.arange(len(rise)), mine[p]] = 0.0
            stays[p] += rise.sum(axis=1)
    out[i, mine] = stays
    return out


def _contexts(row: dict, side: str, s: int, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words x classes without the word itself, how often it follows itself, classes of the words, class pairs)."""
    mine = labels[s::SLICES]
    if row is None:
        return np.zeros((len(mine), k)), np.zeros(len(mine)), mine, np.zeros((k, k))
    w, v, n = np.frombuffer(row["w"], "<i4"), np.frombuffer(row["v"], "<i4"), np.frombuffer(row["n"], "<i8").astype(float)
    pairs = np.bincount(mine[w] * k + labels[v], n, k * k).reshape(k, k)
    itself = w.astype(np.int64) * SLICES + s == v
    own = np.bincount(w[itself], n[itself], len(mine))
    return np.bincount(w[~itself] * np.int64(k) + labels[v[~itself]], n[~itself], len(mine) * k).reshape(-1, k), own, mine, pairs


def class_pairs(slices: DataFrame, labels: np.ndarray, k: int) -> np.ndarray:
    """k x k counts of class pairs over all pairs of held words: k squared numbers a task come to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            for s, r in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total += _contexts(r.as_py(), "r", s, labels, k)[3]
        at = np.flatnonzero(total)
        yield _columns(at=pa.array(at, pa.int64()), n=pa.array(total.ravel()[at], pa.float64()))

    return _square(slices.select("slice", "r").mapInArrow(work, "at long, n double"), k)


def _square(cells: DataFrame, k: int) -> np.ndarray:
    out = np.zeros(k * k)
    for r in cells.groupBy("at").agg(F.sum("n").alias("n")).collect():  # k squared at most
        out[r["at"]] = r.n
    return out.reshape(k, k)


def moves(left: np.ndarray, right: np.ndarray, own: np.ndarray, mine: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The best class of each word, with the others where they are; its own where that is as good. The last class is the
    end token's alone."""
    i, last = np.arange(len(mine)), len(seen) - 1
    gain = gains_of_moves(left, right, own, mine, seen)[:, :last]
    best, held = gain.argmax(axis=1), np.minimum(mine, last - 1)
    return np.where((mine == last) | (gain[i, best] <= gain[i, held] + 1e-9), mine, best)


def _coin(words: np.ndarray, toss: int) -> np.ndarray:
    """0 or 1 for each word, by a hash of its place."""
    return (words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40 + toss)) & np.uint64(1)


def exchange(slices: DataFrame, held: int, end: int, k: int) -> tuple[np.ndarray, list[float]]:
    """(class of each held word, likelihoods): the words are dealt out by falling count. In each sweep half of them move at
    once, each to the class that raises the likelihood most if it moved alone. Should all of them together not raise it,
    half of the moves are taken back, and so on: it never falls. Only these classes and counts of class pairs come to the
    driver."""
    labels = np.arange(held) % (k - 1)
    labels[end] = k - 1
    seen = class_pairs(slices, labels, k)
    found = [likelihood(seen)]
    for sweep in range(SWEEPS):

        def work(batches: Iterator[pa.RecordBatch], labels: np.ndarray = labels, seen: np.ndarray = seen, sweep: int = sweep) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s, r, l in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):  # noqa: E741
                    right, own, mine, _ = _contexts(r.as_py(), "r", s, labels, k)
                    left = _contexts(l.as_py(), "l", s, labels, k)[0]
                    turn = np.flatnonzero(_coin(np.arange(len(mine)) * SLICES + s, 0) == sweep % 2)
                    new = moves(left[turn], right[turn], own[turn], mine[turn], seen)
                    yield _columns(w=pa.array(turn * SLICES + s, pa.int32()), k=pa.array(new, pa.int32()))

        got = slices.mapInArrow(work, "w int, k int").toPandas()  # half of the held words
        trial = labels.copy()
        trial[got.w.to_numpy()] = got.k.to_numpy()
        for back in range(4):
            then = class_pairs(slices, trial, k)
            if likelihood(then) > found[-1]:
                labels, seen = trial, then
                found.append(likelihood(then))
                break
            moved = np.flatnonzero(trial != labels)
            moved = moved[_coin(moved, back + 1) == 0]
            trial[moved] = labels[moved]
    return labels, found


def read_documents(docs: DataFrame, held: list[bytes], counts: np.ndarray, labels: np.ndarray) -> DataFrame:
    """One row per row of docs: uid, doc_id, held_out, n_tokens, known, top (sum of log10(n + ALPHA) over the held words),
    classes (packed: the class of each token, the end token before and after; _NONE for words that aren't held) and rare,
    those words in order: array<struct<w, b, a>> with the classes before and after."""
    shared = docs.sparkSession.sparkContext.broadcast((held, counts, labels))
    kind = dict(docs.dtypes)["doc_id"]
    rare_type = pa.struct([("w", pa.binary()), ("b", pa.int32()), ("a", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, labels = shared.value
        of, logs, uid = {w: i for i, w in enumerate(held)}, np.append(np.log10(counts + ALPHA), 0.0), TaskContext.get().partitionId() << 40
        classes, known = np.append(labels, _NONE).astype("<u2"), np.append(counts > 0, False)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, said, starts = batch.slice(start, 256), [], [0]
                for text in part.column(2):
                    said.append(END)
                    said += tokens(text.as_py())
                    said.append(END)
                    starts.append(len(said))
                at, starts = _places(said, of, len(said)), np.array(starts)
                c, rest, first = classes[at], np.flatnonzero(at < 0), starts[:-1]
                rare = pa.StructArray.from_arrays([pa.array([said[i] for i in rest.tolist()], pa.binary()), *(pa.array(c[x].astype(np.int32)) for x in (rest - 1, rest + 1))], fields=list(rare_type))
                ends, packed = pa.array(np.searchsorted(rest, starts), pa.int32()), pa.array([c[i:j].tobytes() for i, j in zip(first, starts[1:], strict=True)], pa.binary())
                counted, top = known[at], logs[at]
                counted[first], top[first] = False, 0.0  # the end token before a text is not one of its tokens
                yield _columns(uid=pa.array(uid + np.arange(len(first)), pa.int64()), doc_id=part.column(0), held_out=part.column(1), n_tokens=pa.array(np.diff(starts) - 1, pa.int64()), known=pa.array(np.add.reduceat(counted, first, dtype=np.int64)),
                               top=pa.array(np.add.reduceat(top, first)), classes=packed, rare=pa.ListArray.from_arrays(ends, rare))
                uid += len(first)
        of.clear()
        _give_back()

    rows = docs.select("doc_id", (fold_of("doc_id", 10) == 0).alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(work, f"uid long, doc_id {kind}, held_out boolean, n_tokens long, known long, top double, classes binary, rare array<struct<w:binary,b:int,a:int>>")


def place_rare(read: DataFrame, seen: np.ndarray) -> DataFrame:
    """(uid, pos, n, k, w) of every place of a word that isn't held; n: the word's count, k: the class that raises the
    likelihood most as the word joins it, by its own contexts: the classes of the held words before and after it. Words that
    stand among other such words only have one more class to themselves, the last. A word without a count has n = 0 and no
    class: _NONE. w: the word, at the first place of each counted one alone.

    Places are dealt by word once, those in training texts first, so a word's class is known before its other places come."""
    k = len(seen)
    each = read.select("uid", "held_out", F.posexplode("rare").alias("pos", "x")).select("uid", "pos", "held_out", "x.w", "x.b", "x.a")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_of = _best_classes(seen)
        before: tuple = (None, 0, 0)  # word, n and k of the last row, where its word's places in training texts are over
        for t, new in _whole_words(batches, PLACES):
            held_out, w = t.column("held_out").to_numpy(zero_copy_only=False), t.column("w")
            word = np.cumsum(new) - 1
            train = ~held_out
            n, best = np.bincount(word[train], minlength=word[-1] + 1), np.full(word[-1] + 1, _NONE)
            counted = np.flatnonzero(n)
            best[counted] = best_of(np.searchsorted(counted, word[train]), n[counted], *(t.column(c).to_numpy()[train] for c in ("b", "a")))
            if w[0].as_py() == before[0]:
                n[0], best[0] = before[1:]
            before = (w[-1].as_py(), n[-1], best[-1]) if held_out[-1] else (None, 0, 0)
            shown = w.take(pa.array(np.arange(len(w)), mask=~(new & train)))  # if_else() with a null breaks the offsets of a slice
            yield _columns(uid=t.column("uid"), pos=t.column("pos"), n=pa.array(n[word], pa.int64()), k=pa.array(best[word], pa.int32()), w=shown)
        _give_back()

    return each.repartition("w").sortWithinPartitions("w", "held_out").mapInArrow(work, "uid long, pos int, n long, k int, w binary")


def _whole_words(batches: Iterator[pa.RecordBatch], places: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows in order of w and held_out, some `places` together, and which of them begin a word. All places of a word in training
    texts (about one of HELD of all tokens at most) are together; its others may follow later."""
    kept, size, enough = [], 0, places
    for b in chain(batches, [None]):
        if b is not None:
            kept.append(b)
            size += b.num_rows
        if size == 0 or (b is not None and size < enough):
            continue
        t = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        new = np.append(True, pc.not_equal(t.column("w").slice(1), t.column("w").slice(0, size - 1)).to_numpy(zero_copy_only=False))
        cut = size if b is None or t.column("held_out")[size - 1].as_py() else int(np.flatnonzero(new)[-1])
        if cut:
            yield t.slice(0, cut), new[:cut]
        kept, size = [t.slice(cut)], size - cut
        enough = max(places, 2 * size)


def _best_classes(seen: np.ndarray) -> Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The class that each word joins: of the number of the word of each place in ascending order, the words' counts, and the
    classes before and after each place. What a word said once joins is kept by its two neighbours."""
    k, gain = len(seen), gain_of_one(seen)
    once = np.full((k + 1, k + 1), -1)  # the last: a word that isn't held

    def joined(word: np.ndarray, words: int, b: np.ndarray, a: np.ndarray) -> np.ndarray:
        best, ends = np.zeros(words, np.int64), np.searchsorted(word, np.arange(0, words + 2048, 2048))
        for at, i, j in zip(range(0, words, 2048), ends, ends[1:], strict=False):
            m = min(2048, words - at)
            near = [np.bincount((word[i:j] - at)[x < k] * k + x[x < k], minlength=m * k).reshape(m, k) for x in (b[i:j], a[i:j])]
            best[at : at + m] = gain(*near)[:, : k - 1].argmax(axis=1)
            best[at : at + m][(near[0].sum(axis=1) == 0) & (near[1].sum(axis=1) == 0)] = k
        return best

    def of(word: np.ndarray, n: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
        b, a, best = np.minimum(b, k), np.minimum(a, k), np.zeros(len(n), np.int64)
        single = n[word] == 1
        x, y = b[single], a[single]
        missing = np.unique((x * (k + 1) + y)[once[x, y] < 0])
        once[missing // (k + 1), missing % (k + 1)] = joined(np.arange(len(missing)), len(missing), missing // (k + 1), missing % (k + 1))
        best[n == 1] = once[x, y]
        more = np.flatnonzero(n > 1)
        best[more] = joined(np.searchsorted(more, word[~single]), len(more), b[~single], a[~single])
        return best

    return of


def gain_of_one(seen: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """gains() for words that are said a few times: rises by 1 to 8 pairs are looked up instead of worked out anew."""
    k, f, base = len(seen), _xlogx, _xlogx(seen)
    few = np.stack([f(seen + n) - base for n in range(9)])
    few[:, np.arange(k), np.arange(k)] = 0.0
    sums = [seen.sum(axis=1), seen.sum(axis=0)]
    diagonal = seen[np.arange(k), np.arange(k)]

    def of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.zeros(left.shape)
        for near, side in ((left, few), (right, few.transpose(0, 2, 1))):
            w, d = np.nonzero((near > 0) & (near <= 8))
            if len(w):
                first = np.flatnonzero(np.diff(w, prepend=-1))
                out[w[first]] += np.add.reduceat(side[near[w, d].astype(int), d], first, axis=0)
        often = np.flatnonzero((left > 8).any(axis=1) | (right > 8).any(axis=1))
        both = left + right
        w, d = np.nonzero(both)
        out[w, d] += f(diagonal[d] + both[w, d]) - f(diagonal[d])
        for near, other, total in ((right, left, sums[0]), (left, right, sums[1])):
            said = near.sum(axis=1)
            n, at = np.unique(said, return_inverse=True)
            out -= (f(total + n[:, None]) - f(total))[at]
            w, d = np.nonzero(other)
            rise = lambda x: f(x + said[w]) - f(x)  # noqa: B023, E731
            out[w, d] += rise(total[d]) - rise(total[d] + other[w, d])
        if len(often):
            out[often] = gains(left[often], right[often], np.zeros(len(often)), seen)
        return out

    return of


def filled(read: DataFrame, places: DataFrame) -> DataFrame:
    """read_documents() with the classes and counts of its rare words, by place_rare(), filled in: doc_id, held_out, n_tokens,
    n_known, top, classes. A word without a count has no class: _NONE."""
    kind = dict(read.dtypes)["doc_id"]
    each = places.groupBy("uid").agg(F.collect_list(F.struct("pos", "n", "k")).alias("s"))
    each = each.select(F.col("uid").alias("of"), F.col("s.pos").alias("pos"), F.col("s.n").alias("n"), F.col("s.k").alias("k"))
    rows = read.select("uid", "doc_id", "held_out", "n_tokens", "known", "top", "classes").join(each, F.col("uid") == F.col("of"), "left").drop("uid", "of")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known, top, classes = b.column(3).to_pylist(), b.column(4).to_pylist(), []
            for i in range(b.num_rows):
                c = np.frombuffer(b.column(5)[i].as_py(), "<u2")
                if b.column(6)[i].is_valid:
                    pos, n, k = (b.column(x)[i].values.to_numpy() for x in (6, 7, 8))
                    c = c.copy()
                    c[np.flatnonzero(c == _NONE)[pos]] = k
                    known[i] += int((n > 0).sum())
                    top[i] += float(np.log10(n + ALPHA).sum())
                classes.append(c.tobytes())
            yield _columns(doc_id=b.column(0), held_out=b.column(1), n_tokens=b.column(2), n_known=pa.array(known, pa.int64()), top=pa.array(top, pa.float64()), classes=pa.array(classes, pa.binary()))

    return rows.mapInArrow(work, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, top double, classes binary")


def transitions(rows: DataFrame, k: int) -> np.ndarray:
    """k x k: how often each class follows each, over all tokens of the training rows of filled()."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k)
        for b in batches:
            for packed in b.column(0):
                c = np.frombuffer(packed.as_py(), "<u2").astype(np.int64)
                np.add.at(total, c[:-1] * k + c[1:], 1) if len(c) < 64 else np.add(total, np.bincount(c[:-1] * k + c[1:], minlength=k * k), out=total)
        at = np.flatnonzero(total)
        yield _columns(at=pa.array(at, pa.int64()), n=pa.array(total[at], pa.float64()))

    return _square(rows.filter(~F.col("held_out")).select("classes").mapInArrow(work, "at long, n double"), k)


class Brown:
    """A trained model: the held words with counts and classes, the other words as a table (w, n, k), the rows read by it,
    and what scoring needs."""

    def __init__(self, docs: DataFrame) -> None:
        train = docs.filter(fold_of("doc_id", 10) != 0)
        words = staged(count_words(train))
        self.total, self.distinct = (int(x or 0) for x in words.agg(F.sum("n"), F.count("*")).first())
        self.held, self.counts = held_words(words)
        discard(words)
        k = min(_NONE - 2, max(CLASSES, math.ceil(self.distinct**0.3)))
        slices = staged(slices_of(count_pairs(train, self.held), len(self.held)))
        self.labels, self.likelihoods = exchange(slices, len(self.held), self.held.index(END), k)
        read = staged(read_documents(docs, self.held, self.counts, self.labels))
        pairs_of = class_pairs(slices, self.labels, k)
        discard(slices)
        places = staged(place_rare(read, pairs_of))
        self.rare = staged(places.filter(F.col("w").isNotNull()).select("w", "n", "k"))
        self.k = k + 1
        n_class, v_class = (np.bincount(self.labels, x, self.k).astype(float) for x in (self.counts, self.counts > 0))
        for r in self.rare.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # a row a class
            n_class[r.k], v_class[r.k] = n_class[r.k] + r.n, v_class[r.k] + r.v
        self.rows = staged(filled(read, places))
        discard(places)
        discard(read)
        self.seen = transitions(self.rows, self.k)
        self.move = np.log10((self.seen + BETA) / (self.seen.sum(axis=1, keepdims=True) + BETA * self.k))
        self.below = -np.log10(n_class + ALPHA * (v_class + 1))
        self.base_below = math.log10(self.total + ALPHA * (self.distinct + 1))


class Paths:
    """Sums over the classes of a packed text, END to END. A word without a count may be of any class: over a run of such
    words all paths of classes are summed up, and what depends on the run's length alone is kept."""

    def __init__(self, move: np.ndarray, below: np.ndarray) -> None:
        self.move, self.below, self.step = move, below, 10 ** (move + below)
        self.over = {1: (10**move, 0.0)}

    def through(self, run: int) -> np.ndarray:
        """classes x classes: log10 of the chance to pass `run` words without a count between two classes."""
        made = max(r for r in self.over if r <= run)
        m, scale = self.over[made]
        while made < run:
            m = self.step @ m
            made, top = made + 1, m.max()
            m, scale = m / top, scale + math.log10(top)
            if made <= 64:
                self.over[made] = m, scale
        return np.log10(np.maximum(self.step @ m, 1e-300)) + scale

    def sum(self, packed: bytes) -> float:
        c = np.frombuffer(packed, "<u2")
        if not (c == _NONE).any():
            return float((self.move[c[:-1], c[1:]] + self.below[c[1:]]).sum())
        at = np.flatnonzero(c != _NONE)
        p, q, run = c[at[:-1]], c[at[1:]], np.diff(at) - 1
        total = float(self.below[q].sum() + self.move[p[run == 0], q[run == 0]].sum())
        for r in np.unique(run[run > 0]).tolist():
            total += float(self.through(r)[p[run == r], q[run == r]].sum())
        return total


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Counts are over all training rows (fold of the id modulo 10 not 0). Every word counted there gets its class by its own
    contexts: the most frequent ones by sweeps of the exchange, each other one when it joins the class that raises the
    likelihood most. score sums, over a text's words and its end, log10 P(class | class before) + log10 P(word | class),
    both with additive smoothing; a word without a count may be of any class, and all such paths are summed. Null texts count
    as empty: just an end token. Repeated rows are each returned. Without training rows all counts are 0. An empty table
    gives no rows; other columns are not read. The texts are read three times; after that classes stand for words.
    """
    m = Brown(docs)
    move, below, base_below = m.move, m.below, m.base_below

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = Paths(move, below)
        for b in batches:
            top, n, scores = b.column(4).to_numpy(), b.column(2).to_numpy(), [paths.sum(packed.as_py()) for packed in b.column(5)]
            base, score = pa.array(top - n * base_below, pa.float64()), pa.array(top + np.array(scores), pa.float64())
            yield _columns(doc_id=b.column(0), held_out=b.column(1), n_tokens=b.column(2), n_known=b.column(3), base_score=base, score=score)

    kind = dict(docs.dtypes)["doc_id"]
    out = m.rows.mapInArrow(work, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(m.total).cast("long").alias("train_tokens"), "base_score", "score")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
