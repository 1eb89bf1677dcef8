"""Labelled samples for the classifiers: bounded, from the training fold, the same in every run."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import held_out


def clean_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y: one row per document of the training fold; the larger label where rows disagree, nulls left out."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, y, text of at most ``per_class`` labelled documents of each label, by least hash of the id, and the counts
    of all labelled documents by label. Labels without a document count for nothing; of rows that repeat an id the least
    text is taken. The ids that are broadcast number 2 * ``per_class`` at most.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    known = clean_labels(labels, label).join(texts.where(~held_out()).select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("y = 0").orderBy(*order).limit(per_class).unionByName(known.where("y = 1").orderBy(*order).limit(per_class))
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), counts


def calibrated(margins: np.ndarray, y: np.ndarray, counts: dict[int, int]) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins; rows weigh so that the labels' shares are those of all labels."""
    total = max(1, sum(counts.values()))
    weight = np.where(y == 1, counts.get(1, 0) / total / max(1, (y == 1).sum()), counts.get(0, 0) / total / max(1, (y == 0).sum()))
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = float(np.abs(margins).mean()) or 1.0
    x, a, b = margins / scale, 1.0, 0.0
    for _ in range(100):  # Newton steps with a little ridge
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * x).sum() + 1e-6 * a, g.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-6, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, a / scale), b


def probability(margins: np.ndarray, slope: float, offset: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * margins + offset, -35, 35)))
