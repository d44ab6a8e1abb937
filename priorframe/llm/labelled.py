"""Bounded samples of labelled rows, and a calibration curve fitted on them.

``labels`` may hold nulls, repeated and contradicting rows: a document's label is the smallest non-null one for quality
and the largest for toxicity, as the caller says. The sample takes labelled ids in the order of their hash, which does
not depend on partitioning, and is small enough to broadcast by its bound.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 60_000


def held_out(id_col: str, modulus: int, rest: int):
    """True where crc32 of the id as text has this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == rest, F.lit(False))


def training_labels(labels: DataFrame, label: str, modulus: int, rest: int, limit: int = MAX_LABELLED, pick=F.max) -> DataFrame:
    """``(doc_id, y)``: at most ``limit`` labelled ids outside the held-out remainder."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id", modulus, rest))
    return rows.groupBy("doc_id").agg(pick("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def labelled_texts(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(text binary, y)`` of the documents in a sample of :func:`training_labels`; documents are not shuffled."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")


def logistic(features: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> list[float]:
    """Weights, the intercept last, by Newton steps; without both classes a constant."""
    x = np.column_stack([features, np.ones(len(y))])
    total = max(weight.sum(), 1.0)
    rate = (float((weight * y).sum()) + 0.5) / (total + 1)
    beta = np.zeros(x.shape[1])
    beta[-1] = math.log(rate / (1 - rate))
    if len(set(y.tolist())) < 2:
        return beta.tolist()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = weight * p * (1 - p)
        penalty = ridge * np.eye(len(beta))
        step = np.linalg.solve((x * w[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def probability(features: np.ndarray, beta: list[float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ np.array(beta[:-1]) + beta[-1], -30, 30)))
