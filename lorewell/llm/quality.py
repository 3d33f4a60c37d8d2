"""Quality classifier by positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.common import fold_of, table, text_of

#: Bounds of the two training samples, drawn by a hash of the id: trusted positives and unlabelled texts.
POSITIVES, UNLABELLED = 8_000, 16_000
#: A document is kept at this score or more.
THRESHOLD = 0.7

_LETTERS = [*range(65, 91), *range(97, 123), *range(128, 256)]
_KINDS = np.zeros((256, 6))
_KINDS[65:91, 0] = 1  # capitals
_KINDS[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,'\"-:;?()"], 1] = 1  # symbols
_KINDS[[ord(c) for c in ".,'\"-:;?()"], 2] = 1  # punctuation
_KINDS[48:58, 3] = 1  # digits
_KINDS[[9, 10, 11, 12, 13, 32], 4] = 1  # white space
_KINDS[_LETTERS, 5] = 1  # letters
FEATURES = 13


def features(text: str | None) -> list[float]:
    """Shares and ratios of the whole text that don't depend on its language; an empty text gives zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * FEATURES
    capitals, symbols, marks, digits, blank, letters = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, m = len(words), len(raw)
    return [
        capitals / max(letters, 1), symbols / m, symbols / n, marks / n, digits / m, blank / m, letters / m,
        sum(map(eq, words, islice(words, 1, None))) / n, len({*words}) / n, min(letters / n, 40.0),
        1 - len({*lines}) / len(lines), float(np.log1p(n)), float(np.log1p(n / len(lines))),
    ]


class Model:
    """Linear score over standardised features, squashed to 0..1."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, b: float, prior: float) -> None:
        self.mean, self.scale, self.w, self.b, self.prior = mean, scale, w, b, prior

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.w + self.b, -30, 30)))


def _descend(grad, size: int, steps: int = 600, rate: float = 0.05) -> np.ndarray:
    """Adam on all rows at once: the same rows give the same weights."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled: a classifier of trusted against unlabelled rows has, on average, the
    same output on all positives, so the ratio of its means estimates the share."""
    x, y = np.vstack([p, u]), np.r_[np.ones(len(p)), np.zeros(len(u))]
    share = np.r_[np.full(len(p), 0.5 / len(p)), np.full(len(u), 0.5 / len(u))]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    w = _descend(lambda w: x.T @ (share * (sig(x @ w) - y)) + 1e-4 * w, x.shape[1], 300)
    return float(np.clip(sig(u @ w).mean() / max(sig(p @ w).mean(), 1e-9), 0.05, 0.98))


def fit(p: np.ndarray, u: np.ndarray) -> Model:
    """Minimises the non-negative unbiased risk  prior*E_p[l(g)] + max(0, E_u[l(-g)] - prior*E_p[l(-g)])  with the
    logistic loss. Where the second part falls below zero its gradient is turned round, as in the published method.
    Without a trusted positive the model is flat: every text scores 0.5."""
    if not len(p) or not len(u):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 0.5)
    mean, scale = p.mean(axis=0), np.maximum(p.std(axis=0), 1e-3)
    model = Model(mean, scale, np.zeros(FEATURES), 0.0, 0.5)
    one = lambda x: np.c_[model.inputs(x), np.ones(len(x))]
    p, u = one(p), one(u)
    prior = class_prior(p, u)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def grad(w: np.ndarray) -> np.ndarray:
        gp, gu = p @ w, u @ w
        as_negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        rise = u.T @ sig(gu) / len(u) - prior * (p.T @ sig(gp)) / len(p)
        if as_negative < 0:
            return -rise
        return -prior * (p.T @ sig(-gp)) / len(p) + rise + 1e-4 * np.r_[w[:-1], 0]

    w = _descend(grad, p.shape[1])
    model.w, model.b, model.prior = w[:-1], float(w[-1]), prior
    return model


def sample(rows: DataFrame, most: int) -> DataFrame:
    """(key, value) -> `most` rows of different keys at most, those of the least keys. Keys are hashes, so a bound on them
    that lets about `most` through (ten deviations more) is applied first, in the scan; what reaches one task is bounded."""
    n = max(1, rows.count())
    share = min(1.0, (most + 10 * most**0.5) / n)
    few = rows.filter(F.shiftrightunsigned("key", 1) < F.lit(int(share * (1 << 62)) * 2)) if share < 1 else rows
    return few.groupBy("key").agg(F.min("value").alias("value")).orderBy("key").limit(most)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on a bounded sample of rows whose fold is not 2: POSITIVES trusted ones (label 1) and UNLABELLED of any kind,
    whose labels are not looked at. Both bounds hold at any size; which rows are drawn depends on a hash of id and text,
    and rows that repeat both are one."""
    rows = docs.filter("doc_id is not null").filter(fold_of("doc_id", 4) != 2).select("doc_id", text_of().alias("text"))
    key = lambda seed: F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed)).alias("key")
    good = labels.filter("quality = 1 and doc_id is not null").filter(fold_of("doc_id", 4) != 2)
    good = sample(good.select(F.xxhash64("doc_id").alias("key"), F.col("doc_id").alias("value")), POSITIVES).select(F.col("value").alias("doc_id"))
    # POSITIVES ids at most are broadcast; should their rows be more, they are drawn from once more.
    trusted = sample(rows.join(F.broadcast(good), "doc_id", "left_semi").select(key(1), F.col("text").alias("value")), POSITIVES).withColumn("trusted", F.lit(True))
    unlabelled = sample(rows.select(key(2), F.col("text").alias("value")), UNLABELLED).withColumn("trusted", F.lit(False))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"key": part.key, "trusted": part.trusted, "x": [features(t) for t in part.value]})

    # POSITIVES + UNLABELLED rows of 13 numbers at most come to the driver.
    got = trusted.union(unlabelled).mapInPandas(work, "key long, trusted boolean, x array<double>").toPandas().sort_values(["trusted", "key"], kind="stable")
    part = lambda flag: np.array(got[got.trusted == flag].x.tolist(), float).reshape(-1, FEATURES)
    return fit(part(True), part(False))


def quality_score(model: Model) -> Column:
    """Score of the column text, 0..1; null counts as empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts], float).reshape(-1, FEATURES)))

    return score(text_of())


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Null and empty texts score as a text of zeros; a null
    id is in fold 0; repeated rows are scored each; an empty table gives no rows; other columns are not read."""
    model = train(docs, labels)
    out = docs.select("doc_id", (fold_of("doc_id", 4) == 2).alias("held_out"), quality_score(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score THRESHOLD or more, columns as given. Null and empty texts score as a text of zeros; a
    repeated row stays or goes with its twin; an empty table gives no rows; ids and extra columns don't matter."""
    return docs.filter(quality_score(train(docs, labels)) >= THRESHOLD)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
