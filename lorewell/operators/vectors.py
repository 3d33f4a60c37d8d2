"""Embedding of chunks by any function, and approximate neighbours by coarse cells."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import scalars as S
from lorewell.operators import corpus

#: Texts that an embedding function gets at once; rows that cells are fitted on at most; cells, and those that a query looks
#: into. The given vectors hardly cluster, so recall needs most cells; as many probes as cells are exact.
BATCH, FITTED, CELLS, PROBES = 500, 20_000, 16, 13


def hash_embedding(texts: list[str], dimension: int = 64) -> np.ndarray:
    """Unit vectors that depend on the text alone, for tests: the first eight bytes of SHA-256 start a 64-bit linear
    congruential generator whose states, as signed fractions, are the coordinates. All steps are taken at once."""
    # The generator's factor and increment.
    factor, increment = 6364136223846793005, 1442695040888963407
    powers, sums = [], []
    p, s = 1, 0
    for _ in range(dimension):
        p, s = p * factor % (1 << 64), (s * factor + increment) % (1 << 64)
        powers.append(p)
        sums.append(s)
    seeds = np.array([int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big") for t in texts], np.uint64)
    states = seeds[:, None] * np.array(powers, np.uint64) + np.array(sums, np.uint64)
    x = states.view(np.int64) / 2.0**63
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def embed_chunks(chunks: DataFrame, embed: Callable[[list[str]], np.ndarray], column: str = "content", batch: int = BATCH, dimension: int | None = None) -> DataFrame:
    """chunks with vector: embed(texts) for batches of `batch` texts, in order. A count that differs, vectors of another
    dimension than `dimension` (where it is given) or of several, and numbers that aren't finite are errors. A null text
    counts as empty."""

    def vectors(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), batch):
            part = texts.iloc[at : at + batch].fillna("").tolist()
            got = embed(part)
            if len(got) != len(part):
                raise ValueError(f"{len(got)} vectors for {len(part)} texts")
            made = np.asarray(got, np.float32)
            if len(made) and (made.ndim != 2 or dimension and made.shape[1] != dimension):
                raise ValueError(f"vectors of shape {made.shape[1:]}, not of {dimension or 'one dimension'}")
            if not np.isfinite(made).all():
                raise ValueError("a vector isn't finite")
            out += list(made)
        return pd.Series(out)

    return chunks.withColumn("vector", F.pandas_udf(vectors, "array<float>")(F.col(column)))


def fit_cells(vectors: DataFrame, cells: int = CELLS) -> list[list[float]]:
    """Centres of k-means over unit vectors, fitted on FITTED rows at most, drawn by a hash of the id."""
    # A bound on the hash that lets about FITTED rows through (ten deviations more) comes first: what reaches one task is bounded.
    share = min(1.0, (FITTED + 10 * FITTED**0.5) / max(1, vectors.count()))
    drawn = vectors.select("id", "vector", F.xxhash64("id").alias("key")).filter(F.shiftrightunsigned("key", 33) <= int(share * (1 << 31)))
    sample = drawn.orderBy("key", "id").limit(FITTED)
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = sample.withColumn("size", size).filter("size > 0").select(array_to_vector(F.transform("vector", lambda x: x.cast("double") / F.col("size"))).alias("features"))
    return [c.tolist() for c in KMeans(k=cells, seed=11, maxIter=10).fit(unit).clusterCenters()]


def _nearest(vector: Column, centres: list[list[float]]) -> Column:
    """Numbers of the cells, nearest first."""
    each = F.array(*[F.struct((-S.cosine_similarity(vector, F.array(*map(F.lit, c)))).alias("far"), F.lit(i).alias("cell")) for i, c in enumerate(centres)])
    return F.transform(F.array_sort(each), lambda x: x["cell"])


def ann_topk(queries: DataFrame, vectors: DataFrame, centres: list[list[float]], k: int = 5, probes: int = PROBES) -> DataFrame:
    """As corpus.vector_topk(), but a query meets only the rows of its project in the `probes` nearest cells. Every row is
    in a cell; what meets is ranked exactly. (Store vectors partitioned by project and cell to prune the scan too.)"""
    near = queries.withColumn("cell", F.explode(F.slice(_nearest(F.col("query_vector"), centres), 1, probes)))
    best = corpus.nearest(near, vectors.withColumn("cell", F.get(_nearest(F.col("vector"), centres), 0)), ["project_id", "cell"], k)
    return vectors.join(best, ["project_id", "id"]).join(queries.drop("project_id"), "query_id")


#: Embedding functions by the name of their provider: name -> (function of texts, dimension).
_PROVIDERS: dict[str, tuple[Callable[[list[str]], np.ndarray], int]] = {"hash": (hash_embedding, 64)}


def register_provider(name: str, embed: Callable[[list[str]], np.ndarray], dimension: int) -> None:
    """Makes an embedding function known by name (any case); a name that is taken, or no dimension, is an error."""
    if name.lower() in _PROVIDERS or dimension <= 0:
        raise ValueError(f"provider {name} is taken or has no dimension")
    _PROVIDERS[name.lower()] = (embed, dimension)


def embed_by(chunks: DataFrame, provider: str, column: str = "content", batch: int = BATCH) -> DataFrame:
    """embed_chunks() by a provider's name; its vectors are held to its dimension."""
    if provider.lower() not in _PROVIDERS:
        raise ValueError(f"unknown provider {provider}; known: {', '.join(sorted(_PROVIDERS))}")
    embed, dimension = _PROVIDERS[provider.lower()]
    return embed_chunks(chunks, embed, column, batch, dimension)
