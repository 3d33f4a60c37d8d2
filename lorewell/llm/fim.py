"""Fill-in-middle over a Roaring-style set of the offsets at which a text may be cut."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.common import column, table, text_of

# The sentinels.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Offsets that share their high bits share a container; an array holds so many at most, as a bitmap is smaller beyond.
CONTAINER, ARRAY_MOST = 1 << 16, 4096
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Boundaries:
    """A sorted set of offsets: containers by the high 16 bits, each an array, a bitmap or a list of runs, whichever is
    smallest, with the cardinalities summed up before each. select(k) searches those sums, then one container."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        at = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(offsets) else np.zeros(0, np.int64)
        self.keys = high[at]
        self.before = np.r_[at, len(offsets)]
        self.containers = [_container((offsets[a:b] & 0xFFFF).astype(np.uint16)) for a, b in zip(at, self.before[1:], strict=True)]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        c = int(np.searchsorted(self.before, k, side="right")) - 1
        kind, *held = self.containers[c]
        return (int(self.keys[c]) << 16) + _SELECT[kind](k - int(self.before[c]), *held)


def _container(low: np.ndarray) -> tuple:
    breaks = np.flatnonzero(np.diff(low.astype(np.int32)) != 1) + 1
    if 4 * (len(breaks) + 1) < min(2 * len(low), CONTAINER // 8):
        first = np.r_[0, breaks]
        return "runs", low[first], first
    if len(low) <= ARRAY_MOST:
        return "array", low
    bits = np.zeros(CONTAINER, np.uint8)
    bits[low] = 1
    held = np.packbits(bits, bitorder="little")
    return "bitmap", held, np.r_[0, np.cumsum(_ONES[held].reshape(-1, 64).sum(axis=1, dtype=np.int64))]


def _in_bitmap(k: int, held: np.ndarray, sums: np.ndarray) -> int:
    block = int(np.searchsorted(sums, k, side="right")) - 1
    ones = np.flatnonzero(np.unpackbits(held[64 * block : 64 * block + 64], bitorder="little"))
    return 512 * block + int(ones[k - int(sums[block])])


def _in_runs(k: int, starts: np.ndarray, before: np.ndarray) -> int:
    run = int(np.searchsorted(before, k, side="right")) - 1
    return int(starts[run]) + k - int(before[run])


_SELECT = {"array": lambda k, low: int(low[k]), "bitmap": _in_bitmap, "runs": _in_runs}


def ends_of(text: str, unit: str = "token") -> np.ndarray:
    """Where each unit of a text ends, in code points: a token `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`, a line
    with its newline, or a character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if unit == "character" or n == 0:
        return np.arange(1, n + 1)
    if unit == "line":
        last = points == 10
    else:
        blank = (points == 32) | ((points >= 9) & (points <= 13))
        last = ~blank & np.r_[blank[1:], True]
    last[-1] = True
    return np.flatnonzero(last) + 1


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, unit: str = "token") -> DataFrame:
    """Per row of docs: doc_id, n (its units), form (plain, psm or spm), prefix_chars, middle_chars (code points, null if
    plain), output.

    Both cuts come from the hash of seed and doc_id, so a rerun gives the same; `rate` per cent of the texts are cut, of
    those `spm_rate` per cent with the suffix first. A text that is empty or holds a sentinel stays plain. Null texts
    count as empty, a null id as the empty text; rows that repeat id and text come out alike, and an empty table gives no
    rows; other columns are not read. A task holds one Arrow batch; a text of n characters takes some 15 n bytes there,
    once. Nothing is shuffled.
    """
    kind = dict(docs.dtypes)["doc_id"]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(column("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    rows = docs.select("doc_id", text_of().alias("text"), *[number(i).alias(f"h{i + 1}") for i in range(4)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [cut(*row) for row in zip(*[batch.column(c).to_pylist() for c in ("text", "h1", "h2", "h3", "h4")], strict=True)]
            n, form, before, middle, output = zip(*made, strict=True) if made else ([],) * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def cut(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        ends = ends_of(text, unit)
        n = len(ends)
        if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
            return n, "plain", None, None, text
        held = Boundaries(np.r_[0, ends])
        a, b = sorted(held.select(h % (n + 1)) for h in (h1, h2))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < spm_rate:
            return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"

    return rows.mapInArrow(work, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text before fill_in_middle(), from its output and form alone: sentinels don't occur within the three parts."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, CASE WHEN a = 0 THEN '' ELSE array_to_string(u[1:a], '') END AS p, CASE WHEN b = a THEN '' ELSE array_to_string(u[a + 1:b], '') END AS m, CASE WHEN b = n THEN '' ELSE array_to_string(u[b + 1:n], '') END AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM g
"""
