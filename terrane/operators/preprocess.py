"""Whitening: centre, z-score, principal components, PCA whitening."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import _matrix


def _moments(points: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance): one small matrix of sums from each partition."""
    head = points.select(F.size("x").alias("m")).first()
    if head is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    m = head["m"]

    def run(frames):
        n, s, ss = 0, np.zeros(m), np.zeros((m, m))
        for f in frames:
            a = np.stack(f["x"].to_numpy())
            n, s, ss = n + len(a), s + a.sum(axis=0), ss + a.T @ a
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "ss": [ss.ravel().tolist()]})

    rows = points.select("x").mapInPandas(run, "n bigint, s array<double>, ss array<double>")
    n, s, ss = 0, np.zeros(m), np.zeros((m, m))
    for r in rows.toLocalIterator():
        n, s, ss = n + r["n"], s + np.array(r["s"]), ss + _matrix(r["ss"], m)
    mean = s / n
    return n, mean, (ss - n * np.outer(mean, mean)) / max(n - 1, 1)


def whiten(points: DataFrame, how: int, dims: int | None = None) -> DataFrame:
    """(id, x): 0 first ``dims`` columns, 1 centred, 2 z-scores, 3 principal components, 4 those with unit variance."""
    if how == 0:
        return points.select("id", F.slice("x", 1, dims).alias("x") if dims else F.col("x"))
    n, mean, cov = _moments(points)
    if not n:
        return points.select("id", "x")
    if how in (1, 2):
        sd = np.sqrt(np.diag(cov)) if how == 2 else np.ones(len(mean))
        if not sd.all():
            raise ValueError("a constant column has no z-score")
        project = np.diag(1 / sd)
    else:
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(values)[::-1][:dims]
        project = vectors[:, order] / (np.sqrt(values[order]) if how == 4 else 1.0)

    def run(frames):
        for f in frames:
            a = (np.stack(f["x"].to_numpy()) - mean) @ project if len(f) else np.zeros((0, 1))
            yield pd.DataFrame({"id": f["id"], "x": a.tolist()})

    return points.select("id", "x").mapInPandas(run, "id bigint, x array<double>")
