"""Toxicity: a linear classifier over character n-grams, its features scaled by naive Bayes log-count ratios.

A text is lower-cased, its white space collapsed, and its character n-grams hashed into buckets; only presence
counts. For each bucket the log ratio of its smoothed document frequencies in both classes scales the feature, and
a regularised logistic regression learns on the scaled features. The model is one weight per bucket and a bias.

The fit uses at most `max_per_class` labelled rows of each class (those with the smallest hashed keys): that is the
documented bound of the sample, and it makes the model a bounded broadcast. Scores cover every row and whole texts.

Nulls and empty texts have no n-grams and score the bias. Labels without a class and keys without a text teach
nothing. Repeated labels count once; a key with several texts teaches one of them. Without rows of both classes the
score is the smoothed share of the positive class (0.5 without any label).
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import column, mix

STRIDE = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 18


@dataclass(frozen=True)
class Params:
    orders: tuple[int, ...] = (3, 4, 5)
    bits: int = 18
    max_per_class: int = 5000
    min_documents: int = 3
    min_ratio: float = 0.5
    smoothing: float = 1.0
    l2: float = 3e-4
    epochs: int = 25
    rate: float = 0.3


@dataclass
class Model:
    """Weights by bucket, already multiplied with the log-count ratios."""
    params: Params
    bias: float
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[buckets(text, self.params)].sum(dtype=np.float64))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))))


def buckets(text: str | None, p: Params) -> np.ndarray:
    """Sorted distinct buckets of a text's n-grams; long texts are read in overlapping pieces."""
    clean = " ".join((text or "").lower().split())
    if not clean:
        return np.zeros(0, np.int32)
    codes = np.frombuffer(f" {clean} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    longest = max(p.orders)
    found = []
    for at in range(0, max(1, len(codes) - longest + 1), PIECE):
        part = codes[at:at + PIECE + longest - 1].astype(np.uint64)
        h, hashed = np.zeros(len(part) + 1, np.uint64), []
        for n in range(1, min(longest, len(part)) + 1):
            h = h[:-1] * STRIDE + part[n - 1:]
            if n in p.orders:
                hashed.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)) >> np.uint64(64 - p.bits))
        found.append(distinct(np.concatenate(hashed).astype(np.int32)) if hashed else np.zeros(0, np.int32))
    return distinct(np.concatenate(found)) if len(found) > 1 else found[0]


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def learn(rows: list[np.ndarray], y: np.ndarray, p: Params) -> tuple[float, np.ndarray]:
    """Bias and weights from the buckets and classes of the sampled rows."""
    size = 1 << p.bits
    weights = np.zeros(size, np.float32)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    prior = np.log((n1 + 1) / (n0 + 1))
    if not n1 or not n0:
        return float(prior), weights
    df = [np.zeros(size), np.zeros(size)]
    for b, c in zip(rows, y):
        df[int(c)][b] += 1
    share = [(d + p.smoothing) / (n + 2 * p.smoothing) for d, n in zip(df, (n0, n1))]
    ratio = np.log(share[1] / share[0])
    used = (df[0] + df[1] >= p.min_documents) & (np.abs(ratio) >= p.min_ratio)
    rows = [b[used[b]] for b in rows]
    # Adagrad over batches of rows in a fixed shuffled order; w is the weight before scaling by the ratio.
    w, g2, bias, gb2 = np.zeros(size), np.full(size, 1e-3), float(prior), 1e-3
    order = np.argsort(mix(np.arange(len(rows), dtype=np.uint64)))
    batch = 32
    for _ in range(p.epochs):
        for at in range(0, len(order), batch):
            take = order[at:at + batch]
            idx = np.concatenate([rows[i] for i in take])
            ends = np.cumsum([len(rows[i]) for i in take])
            x = ratio[idx]
            z = np.diff(np.concatenate(([0.0], np.cumsum(w[idx] * x)))[np.concatenate(([0], ends))]) + bias
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]) / batch
            touched, place = np.unique(idx, return_inverse=True)
            grad = np.bincount(place, weights=np.repeat(err, [len(rows[i]) for i in take]) * x, minlength=len(touched)) + p.l2 * w[touched]
            g2[touched] += grad * grad
            w[touched] -= p.rate * grad / np.sqrt(g2[touched])
            gb2 += err.sum() ** 2
            bias -= p.rate * err.sum() / np.sqrt(gb2)
    weights[:] = w * np.where(used, ratio, 0)
    return float(bias), weights


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", params: Params = Params()) -> Model:
    """Learn from the labelled rows of `docs`; `labels` holds `key` and `label` (1: toxic, 0: not)."""
    known = labels.select(column(key).alias("k"), column(label).cast("int").alias("y")).filter("y IN (0, 1) AND k IS NOT NULL").distinct()
    near = [known.filter(F.col("y") == c).orderBy(F.xxhash64(F.col("k").cast("string")), "k").limit(params.max_per_class) for c in (0, 1)]
    sample = F.broadcast(near[0].union(near[1]))   # at most 2 * max_per_class keys
    rows = (docs.select(column(key).alias("k"), column(text).alias("t")).filter("t IS NOT NULL").join(sample, "k")
            .groupBy("k", "y").agg(F.max("t").alias("t")))

    def train(group: pa.Table) -> pa.Table:
        at = np.argsort(mix(group["k_hash"].to_numpy().view(np.uint64)), kind="stable")
        y = group["y"].to_numpy()[at].astype(np.float64)
        texts = group["t"]
        bias, weights = learn([buckets(texts[int(i)].as_py(), params) for i in at], y, params)
        full = np.flatnonzero(weights)
        return pa.table({"bucket": pa.array(np.concatenate(([-1], full))), "weight": pa.array(np.concatenate(([bias], weights[full].astype(np.float64))))})

    found = (rows.withColumn("k_hash", F.xxhash64(F.col("k").cast("string"))).withColumn("all", F.lit(0)).groupBy("all").applyInArrow(train, "bucket long, weight double")).collect()
    weights = np.zeros(1 << params.bits, np.float32)
    bias = 0.0
    for r in found:
        if r.bucket < 0:
            bias = r.weight
        else:
            weights[r.bucket] = r.weight
    return Model(params, bias, weights)


def score_column(model: Model, text: Column) -> Column:
    """The score of `text`, between 0 and 1."""
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for t in texts.to_pylist()], pa.float64())

    return F.arrow_udf(score, "double")(text)
