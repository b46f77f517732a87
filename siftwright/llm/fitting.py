"""Logistic calibration of a few features, and the labelled rows a model may learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


def fold(doc_id: str, of: int) -> Column:
    """crc32 of the doc_id as text, modulo ``of``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % of


def fit_logistic(x: np.ndarray, y: np.ndarray, counts: dict[int, int], penalty: float = 0.01, rounds: int = 60) -> list[float]:
    """Weights by Newton steps, lightly penalised. Without both classes only the bias is fitted, to the share of ones.

    ``counts`` has the rows of each label that the sample stands for; each sampled row counts for its part of them.
    """
    w = np.zeros(x.shape[1] if x.ndim == 2 else 1)
    if len(y) == 0:
        return w.tolist()
    if y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        w[0] = np.log(share / (1 - share))
        return w.tolist()
    m = np.where(y == 1, counts.get(1, 0) / max(1, (y == 1).sum()), counts.get(0, 0) / max(1, (y == 0).sum()))
    m = m * len(y) / m.sum()
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = m * q * (1 - q) + 1e-9
        w = w + np.linalg.solve((x * s[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (m * (y - q)) - penalty * w)
    return w.tolist()


def logistic(x: list[float], w: list[float]) -> float:
    z = sum(a * b for a, b in zip(x, w))
    return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def marked(labels: DataFrame, column: str, of: int, out: int) -> DataFrame:
    """(id, label) of the labels (0 or 1) to learn from: those whose fold isn't ``out``. An id whose labels disagree tells nothing."""
    marks = labels.select(F.col("doc_id").alias("id"), F.col(column).cast("int").alias("label")).where("label in (0, 1)").where(fold("id", of) != out)
    return marks.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("_other")).where("label = _other").select("id", "label")


def sample(marks: DataFrame, label: int, limit: int) -> DataFrame:
    """At most ``limit`` of one label, the same ones each time."""
    return marks.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(limit)


def texts_of_sample(docs: DataFrame, picked: DataFrame, name: str) -> DataFrame:
    """(label, text) of the picked ids, one text each, as a scratch table.

    Their number is bounded by the sample's limits, so they go to the documents. Of an id's texts the one with the
    smallest hash is taken, before any of them are shuffled.
    """
    d = docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = d.join(F.broadcast(picked), F.col("_doc") == F.col("id"))
    return materialise(found.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text"), name)


def label_counts(rows: DataFrame) -> dict[int, int]:
    return {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
