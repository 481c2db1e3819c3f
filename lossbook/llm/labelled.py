"""Bounded samples of labelled documents, and what both classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents of each class are used for fitting.
PER_CLASS = 3000


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the key as text, mod 4, is 2. A null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, y of at most ``per_class`` documents a class, drawn by a hash of the key; labels that conflict or are null don't count.

    Of several documents with one key the one with the smallest text hash is taken, so the bound holds for any table.
    """
    rows = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("y"), F.max(label).alias("_y")).filter("y = _y").drop("_y")
    )
    chosen = None
    for y in (0, 1):
        part = rows.filter(F.col("y") == y).orderBy(F.xxhash64("_key"), "_key").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = docs.select(key, text).join(F.broadcast(chosen), F.col(key) == F.col("_key"))
    return found.groupBy(key).agg(F.min_by(text, F.xxhash64(text)).alias(text), F.min("y").cast("int").alias("y"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression on soft labels, by Newton steps."""
    weight = np.ones(len(y)) if weight is None else weight
    a = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = sigmoid(a @ w)
        curve = a.T @ (a * (weight * p * (1 - p))[:, None]) + np.diag(penalty)
        step = np.linalg.solve(curve, a.T @ (weight * (y - p)) - penalty * w)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])
