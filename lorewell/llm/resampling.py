"""Importance resampling towards a target distribution, with n-gram hashes taken from running CRCs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.llm.common import UPPER, discard, hash_of_row, staged, table, text_of

BUCKETS, LONGEST = 10_000, 3
#: Words of a text whose CRCs are held at a time.
BLOCK = 1 << 17
_BLANK = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_PLAIN = str.maketrans(UPPER + _BLANK, UPPER.lower() + " " * len(_BLANK))
#: Shifts of fewer bytes have a table of their own.
SHORT = 256


@cache
def _byte_step() -> np.ndarray:
    """The register after one zero byte more, for each value of its lowest byte (reflected polynomial EDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


def _zero_bytes(c: np.ndarray, n: int) -> np.ndarray:
    for _ in range(n):
        c = _byte_step()[c & 0xFF] ^ (c >> 8)
    return c


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 0xFF] ^ tables[1][(c >> 8) & 0xFF] ^ tables[2][(c >> 16) & 0xFF] ^ tables[3][c >> 24]


@cache
def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Shifting by n zero bytes is linear over GF(2), so it is four lookups: (n < SHORT) tables[n], then one for each power
    of two, each made from the one before."""
    base = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    short = [base]
    for _ in range(SHORT):
        short.append(_zero_bytes(short[-1], 1))
    powers = [short[1]]
    for _ in range(40):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.stack(short[:SHORT]), powers


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each CRC as if n zero bytes followed it."""
    short, powers = _shift_tables()
    low = np.minimum(n, SHORT - 1)
    out = short[low, 0, crc & 0xFF] ^ short[low, 1, (crc >> 8) & 0xFF] ^ short[low, 2, (crc >> 16) & 0xFF] ^ short[low, 3, crc >> 24]
    at = np.flatnonzero(n >= SHORT)
    if len(at):
        c, left = crc[at], n[at]
        for bit in range(int(left.max()).bit_length()):
            on = (left >> bit) & 1 == 1
            c[on] = _apply(powers[bit], c[on])
        out[at] = c
    return out


def gram_buckets(text: str | None, longest: int = LONGEST, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, int]]:
    """The buckets of a text's word runs of 1 to `longest` words, block by block, and the words of each block.

    The text, each word after one space, is scanned once: the CRC of everything up to each word's begin and end is kept.
    As crc(ab) = shifted(crc(a), len b) ^ crc(b), a run's CRC is that at its end with that at its begin shifted out. A
    block also holds the words before it that its first runs begin with."""
    words = text.translate(_PLAIN).encode("utf-8", "surrogatepass").split() if text else []
    step, crc, last, reached = _byte_step(), zlib.crc32, 0, 0
    begins, begin_at = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for at in range(0, len(words), BLOCK):
        part = words[at : at + BLOCK]
        before = np.fromiter(accumulate(part, lambda c, w: crc(w, crc(b" ", c)), initial=last), np.uint32, len(part) + 1)
        ends, register, last = before[1:], ~before[:-1], int(before[-1])
        stop = reached + np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        old = len(begins)
        begins = np.r_[begins, ~(step[(register ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (register >> np.uint32(8)))]
        begin_at = np.r_[begin_at, np.r_[reached, stop[:-1]] + 1]
        found = []
        for n in range(1, longest + 1):
            ending = np.arange(max(0, n - 1 - old), len(part))
            begin = ending + old - n + 1
            found.append(ends[ending] ^ shifted(begins[begin], stop[ending] - begin_at[begin]))
        yield (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), len(part)
        keep = max(0, len(begins) - longest + 1)
        begins, begin_at, reached = begins[keep:], begin_at[keep:], int(stop[-1])


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts; each task sums up its own rows, so `buckets` rows a task are shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for found, _ in gram_buckets(text.as_py(), longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    return texts.select(text_of().alias("text")).mapInArrow(work, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket floor(1000 ln of its smoothed share among the targets over that among the raw texts). `buckets` rows at
    most reach the driver, whatever the size of the tables."""
    spark = raw.sparkSession
    s, t = (bucket_counts(x, longest, buckets).withColumnRenamed("n", c) for x, c in ((raw, "s"), (target, "t")))
    found = spark.range(buckets).select(F.col("id").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left")
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in found.collect():
        s[r.bucket], t[r.bucket] = r.s or 0, r.t or 0
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_features, weight (the sum of its features' gains), tie (of the whole row)."""
    kind, held = dict(docs.dtypes)["doc_id"], docs.sparkSession.sparkContext.broadcast(gain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in batch.column("text"):
                words = features = total = 0
                for found, n in gram_buckets(text.as_py(), longest, len(held.value)):
                    words, features, total = words + n, features + len(found), total + int(held.value[found].sum())
                n_words.append(words)
                n_features.append(features)
                weight.append(total)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n_words, n_features, weight)], batch.column("tie")], ["doc_id", "n_words", "n_features", "weight", "tie"])

    rows = docs.select("doc_id", text_of().alias("text"), hash_of_row(docs.select("doc_id", "text")).alias("tie"))
    return rows.mapInArrow(work, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint, tie bigint")


def resample(docs: DataFrame, target: DataFrame, share: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """Per row of docs: doc_id, n_features, weight, score, rank; rank is 1, 2, 3 ... for the floor(share per cent) of the
    texts of `least_words` words or more that have the highest scores (ties to the smaller doc_id, nulls last), else null.

    score is weight and Gumbel noise from a hash of seed and id, so the highest are a draw without replacement in
    proportion to exp(weight / 1000), and a rerun draws the same. Null and empty texts have no features and weight 0; a
    null id hashes as the empty text; an empty table, of docs or target, is none but smoothing; repeated rows count each
    time and take ranks of their own; other columns are not read. Long texts are worked on in blocks.

    Texts are scanned twice, once to count and once to weigh, and never shuffled. What is ranked is narrow and dealt by
    ranges of score and id, so equal scores are no hot key; ranks are places within a range plus the sizes of those
    before it, one row a range.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    able = (F.col("n_words") >= least_words).alias("able")
    # Staged, as dealing by ranges reads its input twice.
    rows = staged(weighed(docs, gains(docs, target)).select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), "tie", able))
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), "tie"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count_if("able").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy()).alias("all"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    drawn = F.col("able") & (place <= F.floor(F.col("all") * share / 100))
    discard(rows)
    return dealt.join(F.broadcast(before), "part").select("doc_id", "n_features", "weight", "score", F.when(drawn, place).cast("long").alias("rank"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
