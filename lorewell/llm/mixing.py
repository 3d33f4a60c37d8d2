"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. Spark expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.llm.common import WORD, fingerprint_of, staged, table, text_of, whole_row

#: Words that an output shard and a block hold about; weights by the source's place; passes over a source at most.
SHARD_WORDS, BLOCK_WORDS, WEIGHTS, MOST, SEED = 1 << 23, 20_000, (1, 2, 3), 3, 17
#: Blocks on either side of a source's cut whose rows are chosen one by one; times that they are gone through for rows that
#: still fit, before one row is changed for another.
NEAR, PASSES = 8, 4


def unit(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts and the seed alone, so reruns agree."""
    return (F.pmod(F.xxhash64(*parts, F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, size) -> source, source_size, target. Sources by code point, null last, weigh 1, 2, 3 and so on; together
    they get all words. Where a share is above MOST times its source it stops there and the rest is shared anew: the
    sources that stop are those with the least size for their weight, so one sorted pass finds them. One row a source."""
    s = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), rank % len(WEIGHTS)).cast("double")).withColumn("most", MOST * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = rest / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.when(level * F.col("weight") <= F.col("most"), level))
    s = s.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return s.select("source", "source_size", F.coalesce(F.col("level") * F.col("weight"), F.col("most")).alias("target"))


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def _ln_factorial(n: Column) -> Column:
    """By Stirling's series at n + 8, less the logarithms of the factors above n."""
    z = n.cast("double") + 8
    above = z - 1
    for i in range(2, 8):
        above = above * (z - i)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) - F.log(above)


def hypergeometric(kk: Column, nn: Column, n: Column, u: Column) -> Column:
    """How many of n draws from nn, kk of them of the first kind, are of that kind: the inverse distribution at u, within
    ten deviations of the mean."""
    share = kk / F.greatest(nn, F.lit(1))
    near = 10 * F.sqrt(n * share * (1 - share)) + 10
    low = F.greatest(F.lit(0).cast("long"), n - (nn - kk), F.floor(n * share - near).cast("long"))
    high = F.least(n, kk, F.ceil(n * share + near).cast("long"))

    def walk(z: Column) -> Column:
        lf, lo = _ln_factorial, z["lo"]
        p = F.exp(lf(kk) + lf(nn - kk) + lf(n) + lf(nn - n) - lf(nn) - lf(lo) - lf(kk - lo) - lf(n - lo) - lf(nn - kk - n + lo))
        start = F.struct(F.lit(-1).cast("long").alias("k"), F.lit(0.0).alias("sum"), p.alias("p"))

        def step(c: Column, i: Column) -> Column:
            sum_ = c["sum"] + c["p"]
            k = F.when((c["k"] < 0) & ((sum_ >= u) | (i >= z["hi"])), i).otherwise(c["k"])
            p_next = F.try_divide(c["p"] * ((kk - i) * (n - i)).cast("double"), ((i + 1) * (nn - kk - n + i + 1)).cast("double"))
            return F.struct(k.alias("k"), sum_.alias("sum"), F.coalesce(p_next, F.lit(0.0)).alias("p"))

        return F.aggregate(F.sequence(lo, F.greatest(lo, z["hi"])), start, step, lambda c: c["k"])

    return _let(F.struct(low.alias("lo"), high.alias("hi")), walk)


def split_quotas(quotas: DataFrame, depth: int) -> DataFrame:
    """(source, quota) -> source, shard, blocks, start: how many of its blocks each of 2 ** depth shards gets, and which
    come first.

    The root holds all quotas. Each node halves its count of blocks: source by source, the left child's part is a
    hypergeometric draw given what earlier sources took, so that the halves are as a fair shuffle would deal them. A
    level is one pass over rows (node, source); a node's sources are gone through in one row of the result."""
    now = quotas.select("source", F.col("quota").alias("kk"), F.lit(0).cast("long").alias("node"))
    for level in range(depth):
        node = Window.partitionBy("node")
        s = now.withColumn("total", F.sum("kk").over(node)).withColumn("order", F.row_number().over(node.orderBy(F.col("source").asc_nulls_last())))
        half = F.floor((F.col("total") + F.col("node") % 2) / 2).cast("long")
        rows = F.array_sort(F.collect_list(F.struct("order", "kk", "source")))
        s = s.withColumn("half", half).withColumn("level", F.lit(level)).groupBy("node", "level", "half", "total").agg(rows.alias("rows"))
        start = F.struct(F.col("half").alias("left"), F.col("total").alias("nn"), F.array().cast("array<bigint>").alias("out"))

        def give(a: Column, r: Column) -> Column:
            x = hypergeometric(r["kk"], a["nn"], a["left"], unit(F.col("node"), F.col("level"), r["source"]))
            return _let(x, lambda x: F.struct((a["left"] - x).alias("left"), (a["nn"] - r["kk"]).alias("nn"), F.concat(a["out"], F.array(x)).alias("out")))

        draw = F.aggregate("rows", start, give, lambda a: a["out"])
        s = s.withColumn("left", draw).select("node", F.explode(F.arrays_zip("rows", "left")).alias("x"))
        child = lambda kk, node: F.struct(kk.alias("kk"), node.alias("node"))
        both = F.array(child(F.col("x.left"), F.col("node") * 2), child(F.col("x.rows.kk") - F.col("x.left"), F.col("node") * 2 + 1))
        now = s.select(F.col("x.rows.source").alias("source"), F.explode(both).alias("y")).select("source", "y.kk", "y.node")
        if level % 4 == 3:
            now = staged(now)
    before = Window.partitionBy("source").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return now.select("source", F.col("node").alias("shard"), F.col("kk").alias("blocks"), F.coalesce(F.sum("kk").over(before), F.lit(0)).cast("long").alias("start"))


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined on keys of the same names, of which null equals null; the left ones stay."""
    right = right.select(*[F.col(c).alias(f"_right_{c}" if c in keys else c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    for more in on[1:]:
        on[0] = on[0] & more
    return left.join(right, on[0], how).drop(*[f"_right_{k}" for k in keys])


def size_of() -> Column:
    return F.regexp_count(text_of(), F.lit(WORD)).cast("long")


def key_of() -> Column:
    """Rows that repeat id and text go together."""
    return F.xxhash64("doc_id", fingerprint_of(text_of()))


def _block(n_blocks: Column) -> Column:
    """A row's block: which of n_blocks equal spans of the hashes it falls into. A source's rows in order of their hash are
    a random permutation, so its blocks, numbered by span, are permuted blocks already."""
    return F.floor(unit(F.col("key")) * n_blocks).cast("long")


def _cuts(blocks: DataFrame) -> DataFrame:
    """(source, block, words, n_blocks, rest) -> source, cut, left: the block in which the running sum of a source passes
    rest, and what is left there. Sums are taken over spans of about the square root of all blocks first, then over the
    blocks of one span, so no window goes over all blocks of a source."""
    span = F.floor(F.col("block") / F.ceil(F.sqrt("n_blocks"))).cast("long")
    b = blocks.withColumn("span", span)

    def passed(rows: DataFrame, by: str) -> DataFrame:
        before = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        return rows.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).withColumn("rest", F.col("rest") - F.col("before"))

    spans = passed(b.groupBy("source", "span", "rest").agg(F.sum("words").alias("words")), "span")
    inside = _beside(b.drop("rest"), spans.select("source", "span", "rest"), ["source", "span"])
    return passed(inside, "block").select("source", F.col("block").alias("cut"), F.col("rest").alias("left"))


def _filling(inside: DataFrame) -> DataFrame:
    """(source, chosen): the keys of the rows of inside(source, key, size, left, taken) that stand for the blocks around
    each source's cut. Rows of the blocks before it are taken at first; left is what is missing then.

    Each pass takes rows in hash order while they fit, of those that are small enough for what the passes before have
    left, so a very long row blocks none behind it. In the end one row, or none, is changed for another, or none: those
    two whose sizes differ most nearly by what is still left. A source has 2 * NEAR such blocks of about BLOCK_WORDS words;
    rows without words aren't among them, so these are as many rows at most, whatever the count of empty texts."""
    source = Window.partitionBy("source")
    line = source.orderBy(F.xxhash64(F.lit(SEED + 2), "key"), "key")
    now = inside.groupBy("source", "key", "left", "taken").agg(F.sum("size").alias("size"))
    for _ in range(PASSES):
        fits = ~F.col("taken") & (F.col("size") <= F.col("left"))
        now = now.withColumn("sum", F.sum(F.when(fits, F.col("size"))).over(line))
        now = now.withColumn("now", fits & (F.col("sum") <= F.col("left")))
        now = now.withColumn("left", F.col("left") - F.coalesce(F.sum(F.when(F.col("now"), F.col("size"))).over(source), F.lit(0)))
        now = now.withColumn("taken", F.col("taken") | F.col("now"))
    # Two rows that are no rows, of size 0, stand for giving none back and for taking none.
    blank = now.groupBy("source").agg(F.first("left").alias("left")).withColumn("key", F.lit(None).cast("long")).withColumn("size", F.lit(0).cast("long"))
    now = now.select("source", "key", "left", "size", "taken")
    now = now.union(blank.select("source", "key", "left", "size", F.lit(True))).union(blank.select("source", "key", "left", "size", F.lit(False)))
    at = now.withColumn("at", F.when(F.col("taken"), F.col("size") + F.col("left")).otherwise(F.col("size").cast("double")))
    order = source.orderBy("at", F.col("taken"), F.col("key").asc_nulls_first())
    other = F.when(~F.col("taken"), F.struct("size", "key"))
    below = F.last(other, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first(other, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    off = lambda o: F.abs(F.col("at") - o["size"])
    at = at.withColumn("below", below).withColumn("above", above)
    pair = F.when(F.coalesce(off(F.col("below")), F.lit(math.inf)) <= F.coalesce(off(F.col("above")), F.lit(math.inf)), F.col("below")).otherwise(F.col("above"))
    at = at.withColumn("pair", F.when(F.col("taken"), pair))
    best = F.min_by(F.struct(F.col("key").alias("out"), F.col("pair.key").alias("in")), F.when(F.col("pair").isNotNull(), F.struct(off(F.col("pair")).alias("off"), "key")))
    at = at.withColumn("swap", best.over(source)).filter("key is not null")
    stays = F.col("taken") & ~F.coalesce(F.col("key") == F.col("swap.out"), F.lit(False)) | F.coalesce(F.col("key") == F.col("swap.in"), F.lit(False))
    return at.groupBy("source").agg(F.collect_list(F.when(stays, F.col("key"))).alias("chosen"))


def mixing_plan(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows(source, key, size) -> one row a source: source, source_size, target, n_blocks, passes, low, high, chosen, width,
    cells; and the count of shards.

    A source gives as many whole passes as its target holds, then the blocks before low, and of those up to high the
    chosen keys: it ends within one row of its target, and mostly much nearer. The blocks it gives are numbered, pass by
    pass; the splitting tree's shards draw disjoint runs of the numbers. cells holds, for each span of width numbers, the
    runs that meet it. There are as many shards (a power of two) as hold SHARD_WORDS each."""
    goal = targets(rows).withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / BLOCK_WORDS)).cast("long"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    goal = staged(goal.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    in_block = _beside(rows, goal.select("source", "n_blocks", "rest"), ["source"]).withColumn("block", _block(F.col("n_blocks")))
    blocks = in_block.groupBy("source", "block", "n_blocks", "rest").agg(F.sum("size").alias("words"))
    cuts = staged(_cuts(blocks.filter("rest > 0")))
    cuts = cuts.withColumn("low", F.greatest(F.lit(0).cast("long"), F.col("cut") - NEAR)).withColumn("high", F.col("cut") + NEAR)
    around = _beside(in_block.drop("rest", "n_blocks"), cuts, ["source"]).filter("block >= low and block < high and size > 0")
    chosen = _filling(staged(around.select("source", "key", "size", "left", (F.col("block") < F.col("cut")).alias("taken"))))
    goal = staged(_beside(_beside(goal, cuts.drop("left", "cut"), ["source"], "left"), chosen, ["source"], "left").fillna({"low": 0, "high": 0}))
    quota = F.col("passes") * F.col("n_blocks") + F.least("high", "n_blocks")
    words = goal.agg(F.sum("target")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(1, words / SHARD_WORDS))))
    runs = split_quotas(goal.select("source", quota.alias("quota")), depth).filter("blocks > 0")
    every = Window.partitionBy("source")
    runs = runs.withColumn("width", F.ceil(F.sum("blocks").over(every) / F.count("*").over(every)).cast("long"))
    meets = F.sequence(F.floor(F.col("start") / F.col("width")), F.floor((F.col("start") + F.col("blocks") - 1) / F.col("width")))
    cells = runs.withColumn("cell", F.explode(meets)).groupBy("source", "width", "cell").agg(F.array_sort(F.collect_list(F.struct("start", "shard"))).alias("runs"))
    cells = cells.groupBy("source", "width").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "runs"))), lambda c: c["runs"]).alias("cells"))
    return staged(_beside(goal.drop("rest"), cells, ["source"], "left")), 1 << depth


def placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows(source, key, ...) with the columns of their source's plan and places: array<struct<shard, turn>>, an entry for
    each time that the row is in the mix. The plan has one row a source; Catalyst broadcasts it if its size allows."""
    at = _beside(rows, plan, ["source"]).withColumn("block", _block(F.col("n_blocks")))
    more = (F.col("block") < F.col("low")) | (F.col("block") < F.col("high")) & F.coalesce(F.array_contains("chosen", F.col("key")), F.lit(False))
    last = F.col("passes") + F.when(more, 1).otherwise(0)

    def place(k: Column) -> Column:
        number = (k - 1) * F.col("n_blocks") + F.col("block")
        runs = F.get("cells", F.floor(number / F.col("width")).cast("int"))
        run = F.element_at(F.filter(runs, lambda r: r["start"] <= number), -1)
        return F.struct(run["shard"].cast("int").alias("shard"), F.xxhash64(F.lit(SEED + 3), "key", k).alias("turn"))

    each = F.filter(F.sequence(F.lit(1).cast("long"), F.greatest(last, F.lit(1).cast("long"))), lambda k: k <= last)
    return at.withColumn("places", F.transform(each, place))


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, shards (that of each time it is taken).

    Rows fall into blocks of their source by a hash of id and text. Null texts have size 0; a null source is a source;
    rows that repeat id and text go together, a third of all rows as well; an empty table gives no rows; other columns are
    not read. The texts are read once."""
    rows = staged(docs.select("doc_id", "source", key_of().alias("key"), size_of().alias("size")))
    out = placed(rows, mixing_plan(rows.select("source", "key", "size"))[0])
    taken = (F.col("size") * F.size("places")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.transform("places", lambda p: p["shard"]).alias("shards"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it was drawn; partition k of the result is shard k, whole and shuffled. Columns
    as given, whatever their names; nulls, repeats and empty tables as in mix()."""
    rows = staged(docs.select("source", key_of().alias("key"), size_of().alias("size")))
    plan, shards = mixing_plan(rows)
    out = placed(docs.select(whole_row(docs).alias("all"), "source", key_of().alias("key")), plan).select("all", F.explode("places").alias("place"))
    return out.repartitionById(shards, F.col("place.shard")).sortWithinPartitions("place.turn").select("all.*")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
