"""Labelled rows for the classifiers: the learning folds and bounded,
reproducible samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the folds; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def sample(labels: DataFrame, label: str, per_class: int, balanced: bool) -> DataFrame:
    """(doc_id, y) of at most ``per_class`` learning rows of each class, the
    first in hash order of the id; ``balanced`` takes as many of either.  Fold
    0 and null labels never enter; a row labelled twice counts with its
    larger label."""
    known = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    take = {0: per_class, 1: per_class}
    if balanced:
        have = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        take = dict.fromkeys(take, min(per_class, *(have.get(y, 0) for y in take)))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(n)
             for y, n in take.items()]
    return parts[0].unionByName(parts[1])


def fit_logistic(x, y, ridge: float = 1e-2, steps: int = 50):
    """Weights (bias last) of a logistic regression by Newton steps."""
    import numpy as np
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], ridge)
    reg[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + reg * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(reg)
        d = np.linalg.solve(h, g)
        w = w - d * min(1.0, 5.0 / (np.abs(d).max() + 1e-12))
        if np.abs(d).max() < 1e-8:
            break
    return w
