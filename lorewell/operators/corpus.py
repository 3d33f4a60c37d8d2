"""Chunking, sync, mutation and retrieval over corpus tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lorewell.functions import scalars as S

#: Rows and queries of a key that make a block; groups of blocks whose best rows are ranked before all are.
BLOCK_ROWS, BLOCK_QUERIES, SALTS = 2048, 512, 64


def chunk_documents(docs: DataFrame, target: int = 384, overlap: int = 40, most: int = 100) -> DataFrame:
    """(id, text, and language if there is one) -> id, chunk_index, start_line, end_line (1-based, inclusive), content, content_hash, token_count.

    A chunk ends before the line that would pass the target once it has 5 lines (or twice the target) and that line is a
    boundary (or twice the target is reached), at `most` lines, or at the end. The next one starts so that trailing
    lines of `overlap` tokens at most repeat. A Python loop over Arrow batches: the same walk as nested higher-order
    functions took 45 s instead of 2 s on a thousand documents, as Catalyst works their prefix sums out anew.
    """
    target, overlap, most = chunk_options(target, overlap, most)
    kind = dict(docs.dtypes)["id"]
    language = F.col("language") if "language" in docs.columns else F.lit("")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for id_, text, language in zip(frame["id"], frame["text"], frame["language"], strict=True):
                lines = text.split("\n")
                out += [(id_, k, i + 1, e, "\n".join(lines[i:e])) for k, (i, e) in enumerate(chunk_spans(lines, target, overlap, most, language))]
            yield pd.DataFrame(out, columns=["id", "chunk_index", "start_line", "end_line", "content"])

    d = docs.filter(S.non_blank(F.col("text"))).select("id", S.normalize_newlines(F.col("text")).alias("text"), language.alias("language"))
    d = d.mapInPandas(work, f"id {kind}, chunk_index int, start_line int, end_line int, content string")
    return d.select("*", S.content_hash(F.col("content")).alias("content_hash"), S.estimate_tokens(F.col("content")).alias("token_count"))


def chunk_options(target: int, overlap: int, most: int) -> tuple[int, int, int]:
    """The options that are used where those given make no sense."""
    target = target if target > 0 else 384
    return target, 40 if overlap < 0 or overlap >= target else overlap, most if most > 0 else 100


# What counts as white space. U+001C to U+001F don't, though Python's own rules say so.
_BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD, _LEADING = re.compile(f"[^{_BLANKS}]+"), re.compile(f"^[{_BLANKS}]+")


def chunk_spans(lines: list[str], target: int, overlap: int, most: int, language: str | None = "") -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk, 0-based."""
    raw = [0 if not x else max(1, int(len(_WORD.findall(x)) * 1.3)) for x in lines]
    opens = tuple(S.BOUNDARIES[S.boundary_name(language)])
    edge = [not (y := _LEADING.sub("", x)) or y.startswith(opens) for x in lines]
    n, at, spans = len(lines), 0, []
    while at < n:
        end, cost = at + 1, max(raw[at], 1)
        while end < n and end - at < most:
            full = cost >= 2 * target
            if cost + max(raw[end], 1) > target and (end - at >= 5 or full) and (edge[end] or full):
                break
            cost += max(raw[end], 1)
            end += 1
        spans.append((at, end))
        if end >= n:
            break
        back = end
        while back > at and sum(raw[back - 1 : end]) <= overlap:
            back -= 1
        at = max(at + 1, back)
    return spans


def sync_diff(existing: DataFrame, scanned: DataFrame, key: tuple[str, ...] = ("project_id", "file_path")) -> DataFrame:
    """(key, content_hash) twice -> both hashes and change: added, modified, unchanged, deleted. Add source_id to the key
    where a project has several sources. A row with a null hash is there all the same; null equals null."""
    there = lambda df, hash_, mark: df.select(*key, F.col("content_hash").alias(hash_), F.lit(True).alias(mark))
    met = there(existing, "old_hash", "_old").join(there(scanned, "new_hash", "_new"), list(key), "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "modified").otherwise("unchanged")
    return met.withColumn("change", change).drop("_old", "_new")


def dedup_embeddings(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """chunks with cached: whether the project's cache has the hash. Never across projects."""
    known = cache.select("project_id", "content_hash").distinct().withColumn("cached", F.lit(True))
    return chunks.join(known, ["project_id", "content_hash"], "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def rejected(rows: DataFrame, required: list[str]) -> Column:
    """Whether a row lacks a required value: null, or an empty array. Keep such rows apart before upsert()."""
    lacks = F.lit(False)
    for c in required:
        lacks = lacks | F.col(c).isNull() | (F.size(c) == 0 if dict(rows.dtypes)[c].startswith("array") else F.lit(False))
    return F.coalesce(lacks, F.lit(True))


def upsert(old: DataFrame, new: DataFrame, key: list[str], changed: list[str]) -> DataFrame:
    """Rows of new over rows of old by key: the changed columns are overwritten, by nulls too, the others keep their old
    value. Of rows of new with the same key one stays (that of the largest hash of all its values). Rows of new with a null
    in the key are rejected (see rejected()), and rows of old are returned as often as given."""
    rest = [c for c in new.columns if c not in key]
    row = F.struct(F.lit(True).alias("_"), *rest)
    n = new.filter(~rejected(new, key)).groupBy(*key).agg(F.max_by(row, F.xxhash64(*(rest or key))).alias("_new"))
    o = old.withColumn("_old", F.lit(True))
    pick = [F.when(F.col("_new").isNotNull() & (F.col("_old").isNull() | F.lit(c in changed)), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in old.columns if c not in key]
    return o.join(n, key, "full_outer").select(*key, *pick)


def update_source_status(sources: DataFrame, new: DataFrame) -> DataFrame:
    """sources and new(source, status, last_commit, synced_at): the new status; commit and time only where they are given."""
    n = new.select("source", *[F.col(c).alias(f"_{c}") for c in ("status", "last_commit", "synced_at")])
    pick = {"status": F.coalesce("_status", "status"), "last_commit": F.coalesce(F.nullif("_last_commit", F.lit("")), "last_commit"), "synced_at": F.coalesce("_synced_at", "synced_at")}
    return sources.join(n, "source", "left").select(*[pick.get(c, F.col(c)).alias(c) for c in sources.columns])


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame, chain: list[tuple[str, list[str]]]) -> dict[str, DataFrame]:
    """tables without the rows that belong to gone: each (table, key) of the chain loses the rows whose key is among those
    deleted one step before, and what it loses is looked for in the next. A null key belongs to nothing."""
    left = dict(tables)
    for name, key in chain:
        left[name] = delete_rows(tables[name], gone, key)
        gone = tables[name].join(gone.select(*key).distinct(), key, "left_semi")
    return left


def delete_rows(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, project_id, query_vector, ...) x (project_id, id, vector, ...): the k likeliest of each query's project,
    with all columns of both and similarity and rank. An id names one row of its project. A query without a project, or a
    row without one, meets nothing; a null vector has similarity null and comes last. See nearest() for the plan."""
    best = nearest(queries, vectors, ["project_id"], k)
    return vectors.join(best, ["project_id", "id"]).join(queries.drop("project_id"), "query_id")


def nearest(queries: DataFrame, vectors: DataFrame, on: list[str], k: int = 5) -> DataFrame:
    """query_id, project_id, id, similarity, rank: the k likeliest rows that agree with a query in all of `on`. Similarities
    that are equal to the twelfth digit go by id.

    Only ids and vectors are joined, packed: the rows of one key into blocks of about BLOCK_ROWS, its queries into blocks of
    about BLOCK_QUERIES. Each pair of blocks is one matrix product, of which the best k a query go on, so a key with a
    third of all rows is many pairs on many tasks, and all pairs are never put out. The blocks of queries are repeated for
    each block of rows, and broadcast where Catalyst finds them small. A window's limit is applied before its shuffle,
    first within the blocks of a salt and then over what they leave."""
    k = k if k > 0 else 5
    met = similarities(queries, vectors, on, k)
    for part in (["query_id", F.col("part") % SALTS], ["query_id"]):
        order = Window.partitionBy(*part).orderBy(F.desc(F.round("similarity", 12)), "id")
        met = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return met.drop("part")


def similarities(queries: DataFrame, vectors: DataFrame, on: list[str], k: int | None = None) -> DataFrame:
    """query_id, project_id, id, part, similarity of all rows that agree with a query in all of `on`, by block products (see
    nearest()); with k, of the best k a query in each block alone. Without it the result is as large as asked for: each
    query with each row of its key."""
    kinds = dict(vectors.dtypes) | dict(queries.dtypes)
    found = packed(vectors, on, "id", "vector", BLOCK_ROWS, "rows")
    asked = packed(queries, on, "query_id", "query_vector", BLOCK_QUERIES, "asked").drop("part", "parts")
    spread = found.select(*on, "parts").distinct().join(asked, on).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = found.drop("parts").join(spread.drop("parts"), [*on, "part"]).select("project_id", "part", "rows", "asked")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                rows, asked = batch.column("rows")[i].values, batch.column("asked")[i].values
                at, of, near = _best(_matrix(asked.field(1)), _matrix(rows.field(1)), k)
                same = lambda c, n=len(at), i=i: pa.array([batch.column(c)[i].as_py()] * n, batch.schema.field(c).type)
                yield pa.RecordBatch.from_arrays([asked.field(0).take(pa.array(at)), same("project_id"), rows.field(0).take(pa.array(of)), same("part"), near], ["query_id", "project_id", "id", "part", "similarity"])

    return pairs.mapInArrow(work, f"query_id {kinds['query_id']}, project_id {kinds['project_id']}, id {kinds['id']}, part int, similarity double")


def packed(rows: DataFrame, on: list[str], id_: str, vector: str, most: int, name: str) -> DataFrame:
    """rows in blocks: on, part, parts (of this key) and, as `name`, an array of (id, vector) in order of id, of about
    `most` rows by a hash of the id. Keys that are null are left out."""
    rows = rows.select(*on, id_, vector).filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on]))
    parts = rows.groupBy(*on).agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(id_), F.col("parts")).cast("int").alias("part")
    return rows.join(parts, on).select(*on, part, "parts", F.struct(id_, vector).alias("_")).groupBy(*on, "part", "parts").agg(F.array_sort(F.collect_list("_")).alias(name))


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors in rows, their dimensions, which are null); rows of a dimension that most others don't have, and zero
    vectors, are zero."""
    null = np.asarray(vectors.is_null())
    size = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), np.int64)
    whole = np.zeros((len(size), int(size.max(initial=0))))
    flat = np.asarray(pc.list_flatten(vectors).cast(pa.float64()).fill_null(np.nan))
    whole[np.arange(whole.shape[1]) < size[:, None]] = flat
    norm = np.sqrt(np.einsum("ij,ij->i", whole, whole))[:, None]
    return np.divide(whole, norm, out=np.zeros_like(whole), where=norm != 0), size, null


def _best(asked: tuple, rows: tuple, k: int | None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(query, row, similarity) of the k best rows of each query, ties in order of the rows, or of all of them; null where
    a vector is."""
    (a, a_size, a_null), (b, b_size, b_null) = asked, rows
    width = min(a.shape[1], b.shape[1])
    near = a[:, :width] @ b[:, :width].T
    near[a_size[:, None] != b_size] = 0
    missing = a_null[:, None] | b_null | np.isnan(near)
    if k is None:
        at, of = np.divmod(np.arange(near.size), max(1, near.shape[1]))
        return at, of, pa.array(near.ravel(), mask=missing.ravel())
    key = -np.round(np.where(missing, -np.inf, near), 12)
    n = min(k, key.shape[1])
    of = np.empty((len(key), n), np.int64)
    for i, x in enumerate(key):
        last = np.partition(x, n - 1)[n - 1]
        few = np.flatnonzero(x <= last)
        of[i] = few[np.argsort(x[few], kind="stable")][:n]
    at = np.repeat(np.arange(len(key)), n)
    of = of.ravel()
    return at, of, pa.array(near[at, of], mask=missing[at, of])


def rrf(rankings: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, key, ranking, rank, ...) -> query_id, key, score: the sum of 1/(k + rank), a key once per ranking. Where
    the rankings have a similarity its maximum follows, and of every other column the first value that isn't empty, in
    order of ranking and rank."""
    k = k if k > 0 else 60
    more = [c for c in rankings.columns if c not in ("query_id", "key", "ranking", "rank")]

    def merged(c: str) -> Column:
        if c == "similarity":
            return F.max(c).alias(c)
        value = F.nullif(c, F.lit("")) if dict(rankings.dtypes)[c] == "string" else F.col(c)
        return F.min_by(value, F.when(value.isNotNull(), F.struct("ranking", "rank"))).alias(c)

    best = rankings.groupBy("query_id", "key", "ranking").agg(F.min("rank").alias("rank"), *map(merged, more))
    return best.groupBy("query_id", "key").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), *map(merged, more))


def hybrid_retrieve(queries: DataFrame, chunks: DataFrame, k: int = 5, least: float = 0.0, filters: list[str] | None = None) -> DataFrame:
    """queries(query_id, project_id, query, query_vector), chunks(project_id, id, vector, content, file_path): the vector
    pool of max(4k, 20), less what is below `least` where that is above 0, is scored by its words; both rankings are fused
    by rrf(), and of what the file filters let through the best k stay. Blank queries return nothing."""
    k = k if k > 0 else 5
    q = queries.filter(S.non_blank(F.col("query"))).withColumn("query", F.trim("query"))
    pool = scored_pool(vector_topk(q, chunks, candidate_pool(k)), least)
    pool = pool.withColumn("score", fused_score(F.col("rank"), F.col("lexical_rank")))
    if filters:
        pool = pool.filter(S.file_filter(F.col("file_path"), filters))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("similarity"), "id")
    return pool.withColumn("place", F.row_number().over(last)).filter(F.col("place") <= k)


def fused_score(*ranks: Column, k: int = 60) -> Column:
    """What rrf() gives a row that each ranking names once at most; a null rank is none."""
    return reduce(lambda a, b: a + b, [F.coalesce(1.0 / (k + r), F.lit(0.0)) for r in ranks])


def candidate_pool(k: int) -> int:
    """How many rows by vectors are looked at for the best k."""
    return max(4 * k, 20)


def scored_pool(pool: DataFrame, least: float = 0.0) -> DataFrame:
    """Rows of vector_topk(), less those below `least` where that is above 0, with lexical and lexical_rank: null for rows
    that none of the query's words meet; ties go by the rank of the vectors."""
    if least > 0:
        pool = pool.filter(F.col("similarity") >= least)
    pool = pool.withColumn("lexical", F.round(S.lexical_score(F.col("query"), F.col("content"), F.col("file_path")), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("lexical"), "rank")
    return pool.withColumn("lexical_rank", F.when(F.col("lexical") > 0, F.row_number().over(order)))


def rankings_union(pool: DataFrame) -> DataFrame:
    """(query_id, key, ranking, rank, similarity, file_path): the ranking by vectors, and that by words of the rows that
    have one."""
    both = F.array(F.struct(F.lit(1).alias("ranking"), F.col("rank")), F.struct(F.lit(2).alias("ranking"), F.col("lexical_rank").alias("rank")))
    each = pool.select("query_id", F.col("id").alias("key"), "similarity", "file_path", F.explode(both).alias("x"))
    return each.select("query_id", "key", "x.ranking", "x.rank", "similarity", "file_path").filter("rank is not null")


_CHUNK = {"chunk_index": T.IntegerType(), "start_line": T.IntegerType(), "end_line": T.IntegerType(), "content": T.StringType(), "content_hash": T.StringType(), "token_count": T.IntegerType()}


@F.udtf(returnType=T.StructType([T.StructField(*c) for c in _CHUNK.items()]))
class ChunkText:
    """chunk_text(text, language[, target, overlap, most]) for SQL: the rows of chunk_documents() for one text; none for a null
    or blank one. Call it by LATERAL after register_chunk_text()."""

    def eval(self, text, language=None, target=384, overlap=40, most=100):
        text = re.sub("\r\n?", "\n", text or "").removesuffix("\n")
        if not _WORD.search(text):
            return
        target, overlap, most = chunk_options(target, overlap, most)
        lines = text.split("\n")
        for k, (a, b) in enumerate(chunk_spans(lines, target, overlap, most, language)):
            content = "\n".join(lines[a:b])
            words = len(_WORD.findall(content))
            yield k, a + 1, b, content, hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest(), max(1, int(words * 1.3)) if content else 0


def register_chunk_text(spark: SparkSession) -> None:
    spark.udtf.register("chunk_text", ChunkText)


def retrieve_each(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """hybrid_retrieve() with limits a row of queries: top_k (null or not above 0: 5), similarity_min (null: none) and
    file_filters, an array of filters of which one must be met (null or empty: all files; see scalars.path_matches()).

    The largest top_k bounds what a block hands on; it is read first, one number. Filters are compiled once a query."""
    known = lambda c, kind: F.col(c).cast(kind) if c in queries.columns else F.lit(None).cast(kind)
    k = known("top_k", "int")
    q = queries.filter(S.non_blank(F.col("query"))).withColumn("query", F.trim("query")).withColumn("_k", F.when(k > 0, k).otherwise(5))
    q = q.withColumn("_least", F.coalesce(known("similarity_min", "double"), F.lit(0.0))).withColumn("_files", S.compiled_filters(known("file_filters", "array<string>")))
    most = q.agg(F.max("_k")).first()[0] or 5
    pool = vector_topk(q, chunks, candidate_pool(most)).filter(F.col("rank") <= F.greatest(4 * F.col("_k"), F.lit(20)))
    pool = scored_pool(pool.filter((F.col("_least") <= 0) | (F.col("similarity") >= F.col("_least"))))
    pool = pool.withColumn("score", fused_score(F.col("rank"), F.col("lexical_rank"))).filter(S.path_matches(F.col("file_path"), F.col("_files")))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("similarity"), "id")
    return pool.withColumn("place", F.row_number().over(last)).filter(F.col("place") <= F.col("_k")).drop("_k", "_least", "_files")
