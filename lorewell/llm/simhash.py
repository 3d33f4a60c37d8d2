"""SimHash near-duplicates by a segment-popcount embedding."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lorewell.llm.common import discard, hash_of_row, salt_of, salted, salts_of, sieved, staged, table, text_of, whole_row
from lorewell.llm.components import components

WORDS, BITS, BLOCK = 3, 3, 1 << 15
ODD = 0x5555555555555555


def simhash(text: str | None) -> int:
    """Signed 64-bit SimHash of the 3-word shingles, repeats included; 0 without words. Bounded memory: shingles are
    hashed BLOCK at a time."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    n = max(1, len(words) - WORDS + 1)
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + WORDS - 1]
        if len(words) < WORDS:
            grams = [b" ".join(words)]
        else:
            grams = map(b" ".join, zip(part, part[1:], part[2:], strict=False))
        h = np.array([digest(g, 42) for g in grams], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (total * 2 > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


@F.arrow_udf(LongType())
def simhash_of(texts: pa.Array) -> pa.Array:
    return pa.array([simhash(t.as_py()) for t in texts], pa.int64())


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each count as a unary code of two bits (0: 00, 1: 01, 2: 11). The
    Manhattan distance of two embeddings is then the bit count of their XOR, and never above the Hamming distance."""
    half = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(half).bitwiseAND(F.lit(ODD))
    both = fp.bitwiseAND(half).bitwiseAND(F.lit(ODD))
    return some.bitwiseOR(F.shiftleft(both, 1))


def links(fps: DataFrame) -> DataFrame:
    """(a, b) for all pairs of the distinct fingerprints in fps(fp) at BITS or fewer differing bits.

    The embedding is cut into two grids of 16 segments. At a Manhattan distance of 3 or less one grid differs by 1 at
    most, so two points meet in the same cell or in cells one step apart along one axis. Each point stands in its own
    cell of each grid and asks that cell and those one step up. What meets is held to the Manhattan bound over all
    segments, then to the exact Hamming distance. Nothing is capped.
    """
    at = fps.select("fp", embedding(F.col("fp")).alias("e"))
    cells = F.array(F.shiftrightunsigned("e", 32), F.col("e").bitwiseAND(F.lit(0xFFFFFFFF)))
    home = at.select("fp", "e", F.posexplode(cells).alias("grid", "cell"))
    asks = home.select(F.col("fp").alias("ask"), F.col("e").alias("ask_e"), "grid", F.col("cell").alias("own"), F.explode(F.concat(F.array("cell"), _steps_up(F.col("cell")))).alias("cell"))
    met = asks.filter("cell is not null").join(home, ["grid", "cell"]).filter((F.col("own") != F.col("cell")) | (F.col("ask") < F.col("fp")))
    near = met.filter(F.bit_count(F.col("e").bitwiseXOR(F.col("ask_e"))) <= BITS).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("ask"))) <= BITS)
    return near.select(F.col("ask").alias("a"), F.col("fp").alias("b"))


def _steps_up(cell: Column) -> Column:
    """The cells one step up along each of the 16 axes, null where there is none: code 00 becomes 01, 01 becomes 11."""

    def step(i: Column) -> Column:
        code = F.call_function("shiftright", cell, i).bitwiseAND(F.lit(3))
        up = lambda n: cell + F.call_function("shiftleft", F.lit(n).cast("long"), i)
        return F.when(code == 0, up(1)).when(code == 1, up(2))

    return F.transform(F.sequence(F.lit(0), F.lit(30), F.lit(2)), step)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Rows with the same fingerprint link through it: only distinct fingerprints are joined, so a group of copies of any
    size is one point. component_id is the smallest doc_id that a chain of links reaches, null if all ids there are
    null. Null and empty texts have fingerprint zero. Repeated rows are returned as often as given; an empty table
    gives no rows; other columns are not read.
    """
    rows = staged(docs.select("doc_id", simhash_of(text_of()).alias("fp")))
    points = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = staged(components(links(points.select("fp"))))
    joined = points.join(roots, points.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with exactly one row of each group: that of the smallest doc_id (null ids lose, but of null ids only one stays
    too), then of the least hash of all columns (maps left out). Columns as given, whatever their names; null texts count
    as empty; an empty table gives no rows.

    Rows are written once with their fingerprint, and what links reads that column alone. A filter of fixed size then lets
    rows without company go where they are; the others are joined to their group by a salt of the id too, and of a group
    each task hands on one row at most. Rows travel whole, so none has to be named again to be found."""
    rows = staged(docs.select(whole_row(docs).alias("all"), F.col("doc_id").alias("id"), hash_of_row(docs).alias("tie"), simhash_of(text_of()).alias("fp")))
    points = staged(rows.groupBy("fp").agg(F.count("*").alias("copies"), salts_of("id").alias("salts")))
    roots = staged(components(links(points.select("fp"))))
    company = points.join(roots, F.col("fp") == F.col("node"), "left").filter("copies > 1 or root is not null")
    company = staged(company.select("fp", F.coalesce("root", "fp").alias("root"), "salts"))
    marked = sieved(rows, company, ["fp"])
    met = marked.filter("maybe").withColumn("salt", salt_of("id")).join(salted(company).hint("merge"), ["fp", "salt"], "left")
    met = staged(met.select("all", "id", "tie", "root"))
    for used in (points, roots):
        discard(used)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "tie")
    best = met.filter("root is not null").groupBy("root").agg(F.min_by("all", order).alias("all"))
    alone = [marked.filter(~F.col("maybe")), met.filter("root is null"), best]
    return reduce(DataFrame.union, [x.select("all.*") for x in alone])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
