"""Learning from labelled documents: folds, bounded samples, logistic fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50):
    """Logistic regression by damped Newton steps; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out_fold(id_col: Column, folds: int = 5) -> Column:
    """True for rows whose crc32 of the id as text is a multiple of ``folds``; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, of_one: int, of_zero: int,
                  id_col: str = "doc_id", text_col: str = "text"):
    """(texts, labels, base rate) of a bounded sample: of each label the rows
    first in a fixed hash order of their ids, none of them held out."""
    usable = labels.filter(F.col(label_col).isin(0, 1) & ~held_out_fold(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(
        F.max(label_col).cast("int").alias("label"))
    order = F.md5(F.col("id").cast("string"))
    part = lambda v, n: usable.filter(F.col("label") == v).orderBy(order, "id").limit(n)
    chosen = part(1, of_one).union(part(0, of_zero))
    rate = usable.agg(F.avg("label")).first()[0]
    # proven bound: at most of_one + of_zero rows
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(chosen), "id").orderBy("id", "text").collect())
    return [r.text or "" for r in rows], [r.label for r in rows], rate
