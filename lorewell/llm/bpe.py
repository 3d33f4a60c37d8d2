"""BPE encoding and decoding with a pair occurrence index."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.common import table, text_of

#: Words after which a Python worker's memory begins a new generation; the one before is kept too, and a word that is met
#: again moves into the new one, so frequent words stay. Rows and characters that are worked on at once, at least one row.
REMEMBERED, ROWS, CHARACTERS = 40_000, 256, 1 << 20
#: Bytes of a word beyond which its pairs are listed by rank; the rank of a pair that is never merged.
LONG, NONE = 64, 0x7FFFFFFF


def _byte_letters() -> list[str]:
    """The printable letter of each byte: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordBpe:
    """A vocabulary file in the tokenizers library's format whose BPE model has an end-of-word suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.letters = _byte_letters()
        names = {i: t for t, i in self.vocab.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        self.ranks = {(a, b): rank for rank, (a, b, _) in enumerate(self.merges)}
        self.merged = np.array([new for _, _, new in self.merges], np.int32)
        #: Tokens of bytes, 256 more at a word's end, and the ranks of their pairs; all pairs as ascending numbers, and their ranks.
        self.byte_ids = np.array([self.vocab[x + end] for end in ("", self.suffix) for x in self.letters], np.int32)
        self.byte_ranks = np.array([[self.ranks.get((a, b), NONE) for b in self.byte_ids.tolist()] for a in self.byte_ids.tolist()], np.int32)
        keys = sorted((a << 32 | b, rank) for (a, b), rank in self.ranks.items()) or [(-1, NONE)]
        self.keys, self.key_ranks = (np.array(x, kind) for x, kind in zip(zip(*keys, strict=True), (np.int64, np.int32), strict=True))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = names | {i: t for t, i in self.special.items()}
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"), regex.V0)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def words(self, text: str) -> list[str]:
        """Normalised words in order; special tokens stand as they are, with a capital A, which no lower-cased word has, before them."""
        if self.marks is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[str] = []
        for i, part in enumerate(self.marks.split(text)):
            out += ["A" + part] if i % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.pattern.findall(text.lower())

    def encode_words(self, words: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, tokens joined) of each word. All words are laid into one row of
        symbols, and every pair of neighbours is indexed by its position and rank; the first pairs are those of bytes. In a
        word ranks come up in ascending order, each once for all its positions, and a merge renews the entries of the pairs to
        its left and right. A word's merges don't reach past its ends."""
        if not words:
            return []
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(x) for x in raw])
        first = np.cumsum(size) - size
        byte = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)
        byte[first + size - 1] += 256
        rank = np.append(self.byte_ranks[byte[:-1], byte[1:]], NONE)
        rank[first + size - 1] = NONE
        sym, long = self.byte_ids[byte], np.repeat(size > LONG, size)
        self._merge_short(sym, rank, np.flatnonzero(~long), size[size <= LONG])
        for i in np.flatnonzero(size > LONG).tolist():
            part = slice(first[i], first[i] + size[i])
            self._merge_long(sym[part], rank[part])
        live = sym >= 0
        ids = sym[live]
        cuts = [0, *np.cumsum(np.add.reduceat(live, first, dtype=np.int64)).tolist()]
        packed, names = ids.astype("<u4").tobytes(), [self.names[i] for i in ids.tolist()]
        return [(packed[4 * i : 4 * j], " ".join(names[i:j])) for i, j in zip(cuts, cuts[1:], strict=False)]

    def _merge_short(self, out: np.ndarray, rank: np.ndarray, place: np.ndarray, size: np.ndarray) -> None:
        """Merges many words at once, those at the places `place` of out, with so many symbols each. A turn takes the lowest
        rank in the index of each word. out: the symbols, -1 where one was merged into one to its left."""
        sym, rank = out[place], rank[place]
        out[place] = -1
        while len(size):
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, start)
            goes_on = least < NONE
            stays = np.repeat(goes_on, size)
            out[place[~stays]] = sym[~stays]
            sym, rank, place, size = sym[stays], rank[stays], place[stays], size[goes_on]
            if not len(size):
                break
            at = np.flatnonzero(rank == np.repeat(least[goes_on], size))
            fresh = np.diff(at, prepend=-2) != 1  # of overlapping positions, as in aaa, every other one is merged
            at = at[(np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]) % 2 == 0]
            sym[at], rank[at] = self.merged[rank[at]], NONE
            keeps = np.ones(len(sym), bool)
            keeps[at + 1] = False
            size = np.add.reduceat(keeps, np.cumsum(size) - size, dtype=np.int64)
            sym, rank, place = sym[keeps], rank[keeps], place[keeps]
            at -= np.arange(len(at))
            last = np.zeros(len(sym), bool)
            last[np.cumsum(size) - 1] = True
            at = np.concatenate([at, at[at > 0] - 1])
            at = at[~last[at]]
            key = sym[at].astype(np.int64) << 32 | sym[at + 1]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank[at] = np.where(self.keys[found] == key, self.key_ranks[found], NONE)

    def _merge_long(self, out: np.ndarray, rank: np.ndarray) -> None:
        """Merges one word of many symbols, its index held as a list of positions a rank: a merge costs no pass over the word."""
        n, sym = len(out), out.tolist()
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        where: dict[int, list[int]] = {}
        for i in np.flatnonzero(rank < NONE).tolist():
            where.setdefault(int(rank[i]), []).append(i)
        ranks = sorted(where)

        def note(i: int, j: int) -> None:
            got = self.ranks.get((sym[i], sym[j]))
            if got in where:
                where[got].append(i)
            elif got is not None:
                where[got] = [i]
                heapq.heappush(ranks, got)

        while ranks:
            r = heapq.heappop(ranks)
            a, b, new = self.merges[r]
            for i in sorted(where.pop(r)):
                j = nxt[i]
                if j < 0 or sym[i] != a or sym[j] != b:
                    continue
                sym[i], sym[j] = new, -1
                k = nxt[i] = nxt[j]
                if k >= 0:
                    prv[k] = i
                    note(i, k)
                h = prv[i]
                if h >= 0:
                    note(h, i)
        out[:] = sym

    def remember(self, words: set[str]) -> None:
        """Fills known for all words: their ids as bytes and their tokens joined."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        missing = [w for w in words if w not in self.known]
        self.known.update((w, self.older[w]) for w in missing if w in self.older)
        new = [w for w in missing if w not in self.older]
        plain = [w for w in new if w[0] != "A"]
        self.known.update(zip(plain, self.encode_words(plain), strict=True))
        for w in new:
            if w[0] == "A":
                self.known[w] = (self.special[w[1:]].to_bytes(4, "little"), w[1:])

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        out, split = [], [self.words(text) for text in texts]
        self.remember(set().union(*split))
        for words in split:
            ids, decoded = zip(*map(self.known.__getitem__, words), strict=True) if words else ((), ())
            out.append((b"".join(ids), " ".join(decoded)))
        return out


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>), n_tokens, decoded per row; path: a vocabulary file that every machine has. Null texts are
    empty and give no ids; repeated rows are encoded each; other columns are not read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            for ids, decoded, at in _chunks(t, b):
                n = np.array([len(x) // 4 for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ids)), lists, pa.array(n), pa.array(decoded, pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])
        t.forget()  # the worker lives on, and other steps need its memory

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, n_tokens long, decoded string")


def _chunks(t: WordBpe, b: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[str], int]]:
    """A batch some rows at a time (see ROWS and CHARACTERS), words new to the worker encoded together."""
    texts, size, at = [], 0, 0
    for i, x in enumerate(b.column(1)):
        texts.append(x.as_py() or "")
        size += len(texts[-1])
        if len(texts) == ROWS or size >= CHARACTERS or i + 1 == b.num_rows:
            got = t.encode(texts)
            yield [x for x, _ in got], [y for _, y in got], at
            texts, size, at = [], 0, i + 1


def digests_of(encoded: DataFrame) -> DataFrame:
    """Rows of encode_documents() -> doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers),
    decoded_sha256."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ids = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            packed = [hashlib.sha256(ids[i:j].tobytes()).hexdigest() for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(packed, pa.string()), b.column(3)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = encoded.select("doc_id", "ids", "n_tokens", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
    return rows.mapInArrow(work, f"doc_id {dict(encoded.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row, of what encode_documents() returns."""
    return digests_of(encode_documents(docs, path))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), vocabulary())
