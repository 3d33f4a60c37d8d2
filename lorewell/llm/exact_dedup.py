"""Exact duplicates by distributed MSD radix partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.common import ascii_lower, discard, hash_of_row, salt_of, salted, salts_of, sieved, staged, table, text_of, whole_row

#: Bytes of the first digit; each later digit is GROWTH times as wide, so rounds grow with the length's logarithm.
FIRST, GROWTH = 32, 8


def equal_texts(docs: DataFrame, carried: Column) -> tuple[DataFrame, DataFrame]:
    """(alone, classes): alone(row, id), the rows whose normalised text occurs once; classes(row, id, keep_id, group_size,
    round, gid), the others. row is what is carried along for each row, id its doc_id; round and gid name the class.

    Texts are split by successive digits of bytes, most significant first (their byte length goes before them, so all
    members of a group end together). A group leaves when it is a singleton or has ended; what is left moves on to the
    next digit. Groups are told apart by comparing the bytes themselves, never a digest.

    The first digit is counted on narrow rows (length, digit). A filter of fixed size over the groups that have company
    (sieved()) then lets almost all singletons go where they are; only the texts of the others are ever shuffled. Counts
    are aggregated before the shuffle and joined back by a salt of the id too, so a group of any size is spread over
    tasks. The plan is the same at every size.
    """
    text = text_of()
    digit = F.substring(ascii_lower(F.left(text, F.lit(FIRST))).cast("binary"), 1, FIRST)
    rows = docs.select(carried.alias("row"), F.col("doc_id").alias("id"), text.alias("text"), F.octet_length(text).alias("n"), digit.alias("digit"))
    company = rows.groupBy("n", "digit").agg(F.count("*").alias("size")).filter("size > 1")
    marked = sieved(rows, company, ["n", "digit"])
    alone = [marked.filter(~F.col("maybe")).select("row", "id")]
    rest = F.substring(ascii_lower(F.col("text")).cast("binary"), FIRST + 1, 1 << 30)
    left = marked.filter("maybe").select("row", "id", "n", F.lit(0).cast("long").alias("gid"), "digit", rest.alias("rest"))
    left, classes, at, width, key = staged(left), [], FIRST, FIRST, ["gid", "n", "digit"]
    given = left
    while True:
        groups = left.groupBy(*key).agg(F.count("*").alias("group_size"), F.max("id").alias("keep_id"), salts_of("id").alias("salts"))
        groups = staged(groups.filter("group_size > 1").withColumn("next", F.monotonically_increasing_id()))
        met = left.withColumn("salt", salt_of("id")).join(salted(groups).hint("merge"), [*key, "salt"], "left")
        met = staged(met.select("row", "id", "n", F.col("next").alias("gid"), "rest", "keep_id", "group_size"))
        discard(groups)
        alone.append(met.filter("gid is null").select("row", "id"))
        ended = met.filter((F.col("n") <= at) & F.col("gid").isNotNull())
        classes.append(ended.select("row", "id", "keep_id", "group_size", F.lit(len(classes)).alias("round"), "gid"))
        if given is not None:
            discard(given)
            given = None
        going = met.filter((F.col("n") > at) & F.col("gid").isNotNull())
        if going.isEmpty():
            return reduce(DataFrame.union, alone), reduce(DataFrame.union, classes)
        width *= GROWTH
        at += width
        left = going.select("row", "id", "n", "gid", F.substring("rest", 1, width).alias("digit"), F.expr(f"substring(rest, {width + 1})").alias("rest"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, all empty texts are equal, and the largest doc_id of equal texts stays (null ids lose;
    among null ids only, all stay as none can be named). A row that repeats id and text as well is marked like its
    twin. An empty table gives no rows. Other columns are not read.
    """
    sha = F.sha2(ascii_lower(text_of()).cast("binary"), 256)
    alone, classes = equal_texts(docs.select("doc_id", "text"), sha)
    one = alone.select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("row").alias("text_sha256"))
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return one.union(classes.select("id", "keep_id", "group_size", kept, "row"))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """docs with exactly one row of each class of equal texts: that of the largest doc_id (null ids lose, but of null ids
    only one stays too), then of the largest hash of all columns (maps left out). Columns as given, whatever their names;
    null texts count as empty; an empty table gives no rows.

    A row travels whole, so none has to be named again to be found; of a class each task hands on one row at most."""
    rows = docs.select(whole_row(docs).alias("all"), F.col("doc_id"), F.col("text"), hash_of_row(docs).alias("tie"))
    alone, classes = equal_texts(rows, F.struct("all", "tie"))
    best = classes.groupBy("round", "gid").agg(F.max_by("row", F.struct("id", "row.tie")).alias("row"))
    return alone.select("row.all.*").union(best.select("row.all.*"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, {LOWER_SQL} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
       max(doc_id) OVER (PARTITION BY t) = doc_id AS kept, sha256(t) AS text_sha256
FROM d
"""
