"""An index over vectors as data: coarse cells, residual product codes, and the vectors themselves for an exact re-rank."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.operators import corpus
from lorewell.operators.corpus import BLOCK_QUERIES, _matrix, packed
from lorewell.sources.staging import file_system
from lorewell.sources.store import project_of

#: Rows that cells and codes are fitted on at most; rows that make a cell; the most cells, as their centres are sent to all
#: tasks; coordinates and code words of a part of a code; codes of a cell that are read as one row.
FITTED, PER_CELL, MOST_CELLS, WIDE, WORDS, BLOCK = 20_000, 2_000, 4_096, 4, 256, 8_192
#: Shares of the cells that a query looks into, and rows by codes that are compared exactly, times k.
PROBES, RERANKED = 0.75, 20


def _k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of the bounded sample x; an empty cell takes a row of its own."""
    rng = np.random.RandomState(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = _closest(x, centres)
        n = np.bincount(at, minlength=k)
        total = np.stack([np.bincount(at, x[:, j], k) for j in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    far = (centres**2).sum(axis=1)
    return np.concatenate([(far - 2 * x[a : a + 4096] @ centres.T).argmin(axis=1) for a in range(0, max(1, len(x)), 4096)])


class AnnIndex:
    """Approximate neighbours within a project.

    build() fits on a sample of FITTED rows at most, drawn by a hash of the id, and indexes every row: its cell is that of
    the nearest centre (about PER_CELL rows a cell, so cells follow the rows), its code one byte for each WIDE coordinates
    of what the centre leaves over. Codes are written by project and cell in blocks, vectors beside them by project and
    cell. search() reads the codes of the cells near a query, a sixteenth of the vectors' bytes, ranks by them, and
    compares the best RERANKED x k rows exactly, with vectors of those rows' cells alone. A vector of another dimension than
    the sample's, a zero one or a null is in no cell and is not found."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, vectors: DataFrame) -> None:
        """Indexes vectors(project_id, id, vector); an empty table makes an index in which nothing is found."""
        n = vectors.count()
        share = min(1.0, (FITTED + 10 * FITTED**0.5) / max(1, n))
        drawn = vectors.select("vector", F.xxhash64("id").alias("key")).filter(F.shiftrightunsigned("key", 33) <= int(share * (1 << 31))).filter("vector is not null")
        sample = [r.vector for r in drawn.orderBy("key").limit(FITTED).select(F.col("vector").cast("array<double>").alias("vector")).collect()]
        wide = int(np.median([len(v) for v in sample])) if sample else 0
        x = np.array([v for v in sample if len(v) == wide], float) if wide else np.zeros((0, 0))
        x = x[np.linalg.norm(x, axis=1) > 0]
        if len(x):
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            centres = _k_means(x, min(MOST_CELLS, max(1, round(n / PER_CELL)), len(x)))
            rest = np.pad(x - centres[_closest(x, centres)], ((0, 0), (0, -wide % WIDE)))
            books = np.stack([_k_means(rest[:, a : a + WIDE], min(WORDS, len(x))) for a in range(0, rest.shape[1], WIDE)])
        else:
            centres, books = np.zeros((0, 0)), np.zeros((0, 0, WIDE))
        self._write_model(centres, books)
        held = self.spark.sparkContext.broadcast((centres, books))
        kinds = dict(vectors.dtypes)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, books = held.value
            for batch in batches:
                x, size, null = _matrix(batch.column("vector"))
                on = np.flatnonzero(~null & (size == centres.shape[1]) & x.any(axis=1)) if len(centres) else np.zeros(0, int)
                x = x[on, : centres.shape[1]]
                cell = _closest(x, centres) if len(on) else np.zeros(0, int)
                rest = np.pad(x - centres[cell], ((0, 0), (0, -x.shape[1] % WIDE))) if len(on) else x
                codes = np.stack([_closest(rest[:, WIDE * m : WIDE * m + WIDE], b) for m, b in enumerate(books)], axis=1).astype(np.uint8) if len(on) else np.zeros((0, 0), np.uint8)
                kept = batch.take(pa.array(on))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], [*kept.schema.names, "cell", "code"])

        rows = vectors.filter("project_id is not null").select("id", F.col("vector").cast("array<float>").alias("vector"), F.col("project_id").cast("string").alias("project_id"))
        coded = rows.mapInArrow(work, f"id {kinds['id']}, vector array<float>, project_id string, cell int, code binary")
        coded.repartition("project_id", "cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("project_id", "cell").parquet(f"{self.path}/vectors")
        # The codes alone, many to a row, so that a search reads few and narrow rows.
        slim = self.spark.read.schema(coded.select("id", "code", "project_id", "cell").schema).parquet(f"{self.path}/vectors")
        blocks = packed(slim, ["project_id", "cell"], "id", "code", BLOCK, "codes").select("part", "codes", "project_id", "cell")
        blocks.repartition("project_id", "cell").write.mode("overwrite").partitionBy("project_id", "cell").parquet(f"{self.path}/codes")
        self._kind = kinds["id"]

    def _write_model(self, centres: np.ndarray, books: np.ndarray) -> None:
        row = (json.dumps(centres.tolist()), json.dumps(books.tolist()))
        self.spark.createDataFrame([row], "centres string, books string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/model")

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        row = self.spark.read.parquet(f"{self.path}/model").first()
        centres, books = (np.array(json.loads(x), float) for x in row)
        return (centres, books) if len(centres) else (np.zeros((0, 0)), np.zeros((0, 0, WIDE)))

    def candidates(self, queries: DataFrame, most: int, probes: float = PROBES) -> DataFrame:
        """queries(query_id, project_id, query_vector) -> query_id, project_id, cell, id, near: the `most` rows likeliest by
        their codes, from the nearest `probes` of all cells."""
        centres, books = self.model()
        held = self.spark.sparkContext.broadcast((centres, books))
        n = max(1, round(len(centres) * probes))
        kinds = dict(queries.dtypes)

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, _ = held.value
            for batch in batches:
                x, size, null = _matrix(batch.column("query_vector"))
                on = np.flatnonzero(~null & (size == centres.shape[1]) & x.any(axis=1)) if len(centres) else np.zeros(0, int)
                order = np.argsort(-(x[on][:, : centres.shape[1]] @ centres.T), axis=1, kind="stable")[:, :n] if len(on) else np.zeros((0, n), int)
                kept = batch.take(pa.array(np.repeat(on, order.shape[1])))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(order.ravel(), pa.int32())], [*kept.schema.names, "cell"])

        asked = queries.filter("project_id is not null").select("query_id", F.col("project_id").cast("string").alias("project_id"), "query_vector")
        asked = asked.mapInArrow(cells, f"query_id {kinds['query_id']}, project_id string, query_vector {kinds['query_vector']}, cell int")
        asked = packed(asked, ["project_id", "cell"], "query_id", "query_vector", BLOCK_QUERIES, "asked").select("project_id", "cell", "asked")
        pairs = self.codes().join(asked, ["project_id", "cell"]).select("project_id", "cell", "codes", "asked")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, books = held.value
            for batch in batches:
                for i in range(len(batch)):
                    rows, asked = batch.column("codes")[i].values, batch.column("asked")[i].values
                    cell = batch.column("cell")[i].as_py()
                    x, _, _ = _matrix(asked.field(1))
                    codes = np.frombuffer(b"".join(rows.field(1).to_pylist()), np.uint8).reshape(len(rows), -1)
                    whole = np.pad(x, ((0, 0), (0, -x.shape[1] % WIDE))).reshape(len(x), -1, WIDE)
                    near = (x @ centres[cell])[:, None] + np.zeros((1, len(rows)))
                    for m, book in enumerate(books):
                        near += (whole[:, m] @ book.T)[:, codes[:, m]]
                    top = min(most, len(rows))
                    of = np.argpartition(-near, top - 1, axis=1)[:, :top]
                    at = np.repeat(np.arange(len(x)), top)
                    of = of.ravel()
                    same = lambda c, n=len(at), i=i: pa.array([batch.column(c)[i].as_py()] * n, batch.schema.field(c).type)
                    yield pa.RecordBatch.from_arrays([asked.field(0).take(pa.array(at)), same("project_id"), same("cell"), rows.field(0).take(pa.array(of)), pa.array(near[at, of])], ["query_id", "project_id", "cell", "id", "near"])

        met = pairs.mapInArrow(work, f"query_id {kinds['query_id']}, project_id string, cell int, id {self._id_kind()}, near double")
        for part in (["query_id", F.col("cell") % corpus.SALTS], ["query_id"]):
            order = Window.partitionBy(*part).orderBy(F.desc("near"), "id")
            met = met.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")
        return met

    def search(self, queries: DataFrame, k: int = 5, probes: float = PROBES, reranked: int = RERANKED) -> DataFrame:
        """query_id, project_id, id, similarity, rank: as corpus.nearest() over the candidates. Every query needs a project."""
        k = k if k > 0 else 5
        q = queries.select("query_id", project_of(F.col("project_id")).alias("project_id"), "query_vector")
        met = self.candidates(q, reranked * k, probes)
        rows = self.vectors().join(met, ["project_id", "cell", "id"]).select("query_id", "project_id", "id", "vector")
        sim = corpus.S.cosine_similarity(F.col("vector"), F.col("query_vector"))
        scored = rows.join(q.drop("project_id"), "query_id").select("query_id", "project_id", "id", sim.alias("similarity"))
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), "id")
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def _id_kind(self) -> str:
        return dict(self.vectors().dtypes)["id"]

    def codes(self) -> DataFrame:
        return self._read("codes", f"part int, codes array<struct<id:{self._id_kind()},code:binary>>, project_id string, cell int")

    def vectors(self) -> DataFrame:
        if not hasattr(self, "_kind"):
            self._kind = dict(self.spark.read.parquet(f"{self.path}/vectors").dtypes)["id"]
        return self._read("vectors", f"id {self._kind}, vector array<float>, code binary, project_id string, cell int")

    def _read(self, table: str, schema: str) -> DataFrame:
        fs, at = file_system(self.spark, f"{self.path}/{table}")
        fs.mkdirs(at)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
