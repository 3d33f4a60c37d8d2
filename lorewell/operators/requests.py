"""Requests that are taken once a period: the next one only when the period after the last one taken is over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.sources.staging import discard, staged


def accepted_once(requests: DataFrame, period: int) -> DataFrame:
    """requests(id, key, at) -> id, accepted: of each key the first request is taken, then the first one that comes `period`
    or more after the last one taken. Times are whole numbers in the unit of period; of equal times the smaller id comes
    first. A request without a time is refused; null keys are one key. Ids are unique.

    No task walks a key. Time is cut into cells one period wide, of which each holds one taken request at most. A
    request's successor is the first one in the next cell that is late enough, else the first one of the first later cell
    that isn't empty; both come from windows over a cell or over a key's cells. What the first request of a key reaches is
    then found by doubling: successors, their successors' successors, and so on, in as many rounds as the longest
    chain has binary digits, each an equi-join on ids. A key with a third of all requests is spread by id."""
    timed = requests.filter("at is not null").select("id", "key", F.col("at").cast("long").alias("at"))
    # Of requests at one moment only the first can be taken.
    r = timed.groupBy("key", "at").agg(F.min("id").alias("id")).withColumn("cell", F.floor(F.col("at") / period).cast("long"))
    r = staged(r)
    firsts = r.groupBy("key", "cell").agg(F.min(F.struct("at", "id")).alias("first"))
    cells = Window.partitionBy("key").orderBy("cell")
    later = firsts.select("key", "cell", F.lead("cell").over(cells).alias("c1"), F.lead("first").over(cells).alias("f1"), F.lead("first", 2).over(cells).alias("f2"))
    later = later.select("key", "cell", F.when(F.col("c1") > F.col("cell") + 1, F.col("f1.id")).otherwise(F.col("f2.id")).alias("beyond"))
    # Each request asks the next cell for the first one at `at + period` or after.
    none = F.lit(None).cast(dict(r.dtypes)["id"])
    asks = r.select("key", (F.col("cell") + 1).alias("cell"), (F.col("at") + period).alias("at"), F.col("id").alias("ask"), none.alias("id"))
    both = asks.union(r.select("key", "cell", "at", none, "id"))
    after = Window.partitionBy("key", "cell").orderBy("at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    near = both.withColumn("near", F.first("id", ignorenulls=True).over(after)).filter("ask is not null").select(F.col("ask").alias("id"), "near")
    key = F.col("key").eqNullSafe(F.col("_key")) & (F.col("cell") == F.col("_cell"))
    jump = staged(r.join(near, "id").join(later.withColumnsRenamed({"key": "_key", "cell": "_cell"}), key).select("id", F.coalesce("near", "beyond").alias("to")).filter("to is not null"))
    taken = staged(r.groupBy("key").agg(F.min_by("id", "at").alias("id")).select("id"))
    discard(r)
    while not jump.isEmpty():
        more = staged(taken.union(taken.join(jump, "id").select("to")).distinct())
        over = staged(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to")))
        discard(taken)
        discard(jump)
        taken, jump = more, over
    discard(jump)
    return requests.select("id").join(taken.withColumn("accepted", F.lit(True)), "id", "left").select("id", F.coalesce("accepted", F.lit(False)).alias("accepted"))
