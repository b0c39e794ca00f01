"""Small numpy pieces for the trained models: sampling, logistic fits, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lakerules.llm._common import pick, uniform


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def adam(params: list[np.ndarray], gradients, steps: int, rate: float) -> None:
    """Minimise in place; ``gradients(step)`` returns one array per parameter."""
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for p, g, m, v in zip(params, gradients(t), first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)


def calibrate(score: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt scaling: (a, b) of sigmoid(a * score + b) by weighted Newton steps, a held above 0.
    Targets are smoothed, so separable scores stay finite."""
    if len(score) == 0 or label.min() == label.max():
        return 1.0, 0.0
    pos, neg = weight[label == 1].sum(), weight[label == 0].sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.std(score)), 1e-9)
    x = np.stack([score / scale, np.ones_like(score)], 1)
    ab = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ ab)
        grad = x.T @ (weight * (p - target)) + 1e-6 * ab
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(curve, grad)
        ab -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return max(float(ab[0]) / scale, 1e-6), float(ab[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, seed: str) -> DataFrame:
    """``doc_id, text, label`` of at most ``per_class`` documents per label.

    ``docs`` has ``doc_id, text``; ``labels`` has ``doc_id, label``. Chosen are the ids with the
    smallest seeded hash, so the sample is the same in every run. Nulls drop out, and an id that
    is labelled twice keeps its largest label.
    """
    one = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    order = W.partitionBy("label").orderBy("draw", "doc_id")
    drawn = one.withColumn("draw", uniform(seed, F.col("doc_id")))
    drawn = drawn.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_class)
    drawn = drawn.select(F.col("doc_id").alias("drawn_id"), "label")  # at most per_class rows a label
    return docs.join(F.broadcast(drawn), F.col("doc_id") == F.col("drawn_id")).select("doc_id", "text", "label")


def class_shares(labels: DataFrame) -> dict:
    """How many rows each label has, over all of them."""
    return {r["label"]: r["n"] for r in labels.filter("label is not null").groupBy("label")
            .agg(F.count(F.lit(1)).alias("n")).collect()}


def label_rows(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return pick(labels, doc_id=id_col, label=label_col)
