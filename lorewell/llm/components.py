"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.common import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links between values of one orderable type -> (node, root): each linked node and the smallest it reaches.

    Alternates two steps until the edges stand still: every larger neighbour of a node is tied to the smallest
    neighbour, then every node's smaller neighbours are. The count of rounds grows with the logarithm of the longest
    path. Rows move by joins and partial minima, so a hub's neighbours never meet in one task's memory. Links to null
    and self-links are ignored; an empty table gives an empty result.
    """
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a")
        small = tied.select("a", F.col("m").alias("b")).union(tied.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        new = staged(small)
        at = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if tuple(at) == mark:
            break
        mark = tuple(at)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
