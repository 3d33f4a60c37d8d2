"""Document fingerprints by a randomised edit embedding."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.llm.common import discard, salt_of, salted, salts_of, sieved, staged, table, text_of
from lorewell.llm.components import components

#: Sampled places of the embedding, classes of characters, period of the walk's randomness.
SLOTS, CLASSES, PERIOD = 128, 32, 1 << 16
#: Banding: bands of so many sampled places each, and the likeness that verification asks for.
BANDS, PER_BAND, LIKE = 16, 8, 0.8
_SIGNS, _PAD = "0123456789abcdefghijklmnopqrstuv", "-"


@lru_cache(maxsize=1)
def _walk() -> tuple[list[bytes], list[list[int]], list[int]]:
    """Shared by all tasks as the seed is fixed. Stay: steps that a character of each class holds at each time before
    the walk moves on (fair coin tosses). Records: the place of each slot as the embedding grows; the last one below its
    length is uniform over it, and hardly changes when the length does."""
    rng = np.random.RandomState(20240229)
    stay = [bytes(np.minimum(rng.geometric(0.5, PERIOD), 255).astype(np.uint8)) for _ in range(CLASSES)]
    records = []
    for _ in range(SLOTS):
        at, own = 0, [0]
        while at < 1 << 44:
            at = max(at + 1, int((at + 1) / rng.uniform(1e-6, 1)))
            own.append(at)
        records.append(own)
    return stay, records, sorted({x for own in records for x in own})


@lru_cache(maxsize=4096)
def _places(era: int) -> tuple[int, ...]:
    _, records, turns = _walk()
    return tuple(own[bisect_right(own, turns[era]) - 1] for own in records)


def places(n_chars: int) -> tuple[int, ...]:
    """The sampled place of each slot in the embedding of a text of n_chars, about 2*n_chars long."""
    return _places(max(0, bisect_right(_walk()[2], max(2 * n_chars - 1, 0)) - 1))


def classes_of(text: str) -> bytes:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return ((points * np.uint64(0x9E3779B1)) >> np.uint64(13) & np.uint64(CLASSES - 1)).astype(np.uint8).tobytes()


class Walk:
    """A walk over characters that can go on from where it stands; keeps the class found at each wanted place."""

    def __init__(self, wanted: list[int]) -> None:
        self.wanted, self.time, self.k, self.found = wanted, 0, 0, {}

    def copy(self) -> Walk:
        out = Walk(self.wanted)
        out.time, out.k, out.found = self.time, self.k, dict(self.found)
        return out

    def over(self, classes: bytes) -> Walk:
        stay, last, wanted, k, t, found = _walk()[0], PERIOD - 1, self.wanted, self.k, self.time, self.found
        target = wanted[k] if k < len(wanted) else 1 << 62
        for c in classes:
            t += stay[c][t & last]
            while t > target:
                found[target] = c
                k += 1
                target = wanted[k] if k < len(wanted) else 1 << 62
        self.k, self.time = k, t
        return self

    def read(self, at: tuple[int, ...]) -> str:
        found = self.found
        return "".join(_SIGNS[found[p]] if p in found else _PAD for p in at)


def fingerprint(text: str) -> str:
    at = places(len(text))
    return Walk(sorted({*at})).over(classes_of(text)).read(at)


def likeness(a: str, b: str) -> float:
    """Share of equal places: the Hamming likeness that stands for edit likeness."""
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def with_edited(text: str, after: str) -> tuple[str, str, str]:
    """(edited text, fingerprint, its fingerprint); the part that both texts share is walked once."""
    n = len(text)
    cut = n - n // 3
    tail = after[: n // 3]
    edited = text[:cut] + tail
    a, b = places(n), places(len(edited))
    walk = Walk(sorted({*a, *b})).over(classes_of(text[:cut]))
    other = walk.copy()
    return edited, walk.over(classes_of(text[cut:])).read(a), other.over(classes_of(tail)).read(b)


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(text: str, after: str) -> tuple:
    """All columns but doc_id and near_next, which takes the next row's fingerprint."""
    edited, own, changed = with_edited(text, after)
    return len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, changed, likeness(own, changed)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id and the columns of the contract.

    The rows are range-partitioned once, by descending doc_id (ties by text, null ids last); each task walks its sorted
    rows as a stream and knows all successors but that of its last row. Those ends, two rows a task, are written with
    the result and paired afterwards. Null texts count as empty; repeated rows follow each other; a table of one row
    has itself as next; an empty table gives no rows; other columns are not read.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "first", "last"]
        part, before, held, out = TaskContext.get().partitionId(), None, None, []
        for frame in frames:
            for doc_id, text in zip(frame.doc_id.astype(object).where(frame.doc_id.notna(), None), frame.text, strict=True):
                if before is None:
                    out.append((doc_id, *[None] * 6, part, text, None))
                else:
                    row = _row(before[1], text)
                    if held is not None:
                        out.append((*held, likeness(held[3], row[2]), None, None, None))
                    held = (before[0], *row)
                before = (doc_id, text)
                if len(out) >= 256:
                    yield pd.DataFrame(out, columns=columns).astype({"n_chars": "Int64", "part": "Int32"})
                    out = []
        if held is not None:
            out.append((*held, likeness(held[3], fingerprint(before[1])), None, None, None))
        if before is not None:
            out.append((before[0], *[None] * 6, part, None, before[1]))
        if out:
            yield pd.DataFrame(out, columns=columns).astype({"n_chars": "Int64", "part": "Int32"})

    made = staged(rows.drop("tie").mapInPandas(work, f"doc_id {kind}, {_OUT}, part int, first string, last string"))
    first, last = made.filter("first is not null").select(F.col("part").alias("next"), F.col("first").alias("after")), made.filter("last is not null").select("doc_id", "part", F.col("last").alias("text"))
    around = made.filter("first is not null").select("part").withColumn("next", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.orderBy("part"))))
    ends = last.join(around, "part").join(first, "next").select("doc_id", "text", "after")

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = frame.doc_id.astype(object).where(frame.doc_id.notna(), None)
            yield pd.DataFrame([(i, *(r := _row(t, a)), likeness(r[2], fingerprint(a))) for i, t, a in zip(ids, frame.text, frame.after, strict=True)], columns=["doc_id", *[c.split()[0] for c in _OUT.split(", ")]])

    whole = made.filter("part is null").drop("part", "first", "last")
    return whole.union(ends.mapInPandas(finish, f"doc_id {kind}, {_OUT}"))


def alike(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """pairs(a, b, ...) of points(id, fingerprint) with same: in how many sampled places they are equal."""
    named = lambda n, to: points.select(F.col("id").alias(n), F.col("fingerprint").alias(to))
    met = pairs.join(named("a", "f"), "a").join(named("b", "g"), "b")
    return met.withColumn("same", same_places("f", "g")).drop("f", "g")


def same_places(f: str, g: str) -> Column:
    return F.size(F.filter(F.arrays_zip(F.split(f, "").alias("x"), F.split(g, "").alias("y")), lambda p: p["x"] == p["y"]))


def near_links(points: DataFrame) -> DataFrame:
    """(a, b): links between points(id, fingerprint), all fingerprints different. Two points that share a band of sampled
    places and are alike in LIKE of all places or more are joined, by one link or by some; nothing else is.

    Bands that stand alone go first (by a filter of fixed size, so few rows are joined). Then in turns: each band that still
    holds points of several classes names one point of its largest class, and only the points of its other classes are
    compared with that one; what is alike joins the classes. A turn makes one comparison a point and band at most, and bands
    of one class are done. Once a turn no longer halves what is left, the points outside a band's largest class are compared
    with those of its other classes, where they meet: no pair but the alike is kept. No band is left out, that of the padding
    neither. A pair at a likeness of 0.8 shares a band with a chance of 0.95, at 0.9 of 0.9999."""
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("fingerprint", 1 + k * PER_BAND, PER_BAND)) for k in range(BANDS)])
    rows = points.select("id", F.explode(bands).alias("key"))
    company = staged(rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key"))
    members = sieved(rows, company, ["key"]).filter("maybe").join(company, "key", "left_semi")
    members = staged(members.select("key", "id", F.col("id").alias("root")))
    discard(company)
    links, turn, before = [], 0, float("inf")
    while True:
        inside, left = _open_bands(members, turn)
        discard(members)
        last = left["pairs"] <= left["members"] or left["pairs"] > before / 2
        near = _across(inside, points) if last else _to_hubs(inside, points)
        met = staged(_one_hub_each(near.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct()))
        links.append(met)
        if last:
            discard(inside)
            return reduce(DataFrame.union, links)
        roots = components(met).select(F.col("node").alias("root"), F.col("root").alias("now"))
        roots = salted(inside.groupBy("root").agg(salts_of("id").alias("salts")).join(roots, "root"))  # a class may hold a third of all points
        members = inside.withColumn("salt", salt_of("id")).join(roots, ["root", "salt"], "left")
        members = staged(members.select("key", "id", F.coalesce("now", "root").alias("root")))
        discard(inside)
        turn, before = turn + 1, left["pairs"]


def _open_bands(members: DataFrame, turn: int) -> tuple[DataFrame, dict]:
    """members(key, id, root) of the bands with several classes, with top (the largest class) and hub (a point of it, another
    each turn), and what is left: members, and the pairs that _across() would compare at most."""
    each = members.groupBy("key", "root").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("hub"))
    bands = each.groupBy("key").agg(F.max(F.struct("n", "root", "hub")).alias("x"), F.count("*").alias("classes"), F.sum("n").alias("m"))
    bands = staged(bands.filter("classes > 1").select("key", F.col("x.root").alias("top"), "x.hub", "m", (F.col("m") - F.col("x.n")).alias("others")))
    pairs = F.sum(F.col("m").cast("double") * F.col("others"))
    left = bands.agg(F.coalesce(pairs, F.lit(0.0)).alias("pairs"), F.coalesce(F.sum("m"), F.lit(0)).alias("members")).first().asDict()
    inside = staged(members.join(bands.drop("m", "others"), "key"))
    discard(bands)
    return inside, left


def _to_hubs(inside: DataFrame, points: DataFrame) -> DataFrame:
    """The points of a band's other classes that are alike to the hub of its largest one."""
    asked = inside.filter("root <> top").select(F.col("hub").alias("a"), F.col("id").alias("b"), F.col("top").alias("root_a"), F.col("root").alias("root_b"))
    return alike(asked.distinct(), points).filter(F.col("same") >= LIKE * SLOTS)


def _across(inside: DataFrame, points: DataFrame) -> DataFrame:
    """Alike points of a band whose classes differ; one of them at least is outside the largest class."""
    rows = inside.join(points, "id").withColumn("in_top", F.col("root") == F.col("top"))
    side = lambda c: rows.select("key", *[F.col(x).alias(f"{x}_{c}") for x in ("id", "root", "in_top", "fingerprint")])
    met = side("a").filter("not in_top_a").join(side("b"), "key").filter("root_a <> root_b and (in_top_b or id_a < id_b)")
    return met.filter(same_places("fingerprint_a", "fingerprint_b") >= LIKE * SLOTS)


def _one_hub_each(spokes: DataFrame) -> DataFrame:
    """Links(a: hub, b) from BANDS hubs at most to each point: the same classes with one link a point and those among hubs."""
    each = spokes.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("hubs"))
    other = F.transform(F.expr("slice(hubs, 2, size(hubs))"), lambda h: F.struct(F.get("hubs", 0).alias("a"), h.alias("b")))
    link = F.explode(F.concat(F.array(F.struct(F.get("hubs", 0).alias("a"), F.col("b").alias("b"))), other))
    return each.select(link.alias("x")).select("x.a", "x.b").distinct()


def near_documents(prints: DataFrame) -> DataFrame:
    """prints(doc_id, fingerprint, ...) with class_id: the smallest doc_id that near_links() reach, the row's own included
    (null if there are null ids only). Equal fingerprints are one point. Repeated rows have their twin's class; an empty
    table gives no rows."""
    points = staged(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), salts_of("doc_id").alias("salts")).withColumn("id", F.monotonically_increasing_id()))
    roots = components(near_links(points.select("id", "fingerprint")))
    known = points.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    whole = known.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("size"), salts_of("id").alias("salts")).filter("size > 1")
    classes = known.withColumn("salt", salt_of("id")).join(salted(whole), ["root", "salt"])
    classes = staged(classes.select("fingerprint", "class_id", "salts"))
    discard(points)
    marked = sieved(prints, classes, ["fingerprint"])
    met = marked.filter("maybe").withColumn("salt", salt_of("doc_id")).join(salted(classes.withColumn("linked", F.lit(True))), ["fingerprint", "salt"], "left")
    class_id = F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("doc_id"))
    alone = marked.filter(~F.col("maybe")).select(*prints.columns, F.col("doc_id").alias("class_id"))
    return alone.union(met.withColumn("class_id", class_id).select(*prints.columns, "class_id"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(fingerprints(table(spark, sf_dir, "documents")))
