"""Kernel precision of each point for a target perplexity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.functions.lambertw import lambert_wm1
from terrane.session import written

from .neighbours import nearest, q_nn
from .pairs import count_of, kind_of

TOLERANCE, ROUNDS = float(np.log(1 / 0.99999)), 100


def partition_and_entropy(near: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Z, the kernel mass of the others, and the entropy (0 unless Z exceeds 1), for rows of squared distances.

    Each row holds the nearest distances with the point itself first, whose unit of mass is taken off.
    """
    k = np.exp(-beta[:, None] * near)
    z, s = k.sum(axis=1) - 1, (near * k).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return z, np.where(z > 1, beta * s / z + np.log(z), 0.0)


def solve(near: np.ndarray, lq: np.ndarray, ppx: int, xppx: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """(beta, Z) by bisection on the entropy, all rows at once.

    A row whose entropy vanishes above its Lambert value takes that value: there the kernel at the bound falls to the
    level that the target would give it, and bisection would only close in on the jump of the entropy.
    """
    n = len(near)
    with np.errstate(divide="ignore", invalid="ignore"):
        fallback = -lambert_wm1(-2 * np.pi * lq / (xppx * ppx) ** 2) / (2 * lq)
    beta, low, high = np.ones(n), np.zeros(n), np.full(n, np.inf)
    z, live = np.zeros(n), np.ones(n, dtype=bool)
    for _ in range(ROUNDS):
        i = np.flatnonzero(live)
        if not len(i):
            break
        z[i], h = partition_and_entropy(near[i], beta[i])
        with np.errstate(invalid="ignore"):
            take = (h == 0) & (beta[i] > fallback[i])
        t = i[take]
        beta[t] = fallback[t]
        z[t], _ = partition_and_entropy(near[t], beta[t])
        gap = np.log(ppx) - h
        done = take | (np.abs(gap) < TOLERANCE)
        live[i[done]] = False
        up, down = i[~done & (gap < 0)], i[~done & (gap >= 0)]
        low[up] = beta[up]
        beta[up] = np.where(np.isinf(high[up]), 2 * beta[up], (beta[up] + high[up]) / 2)
        high[down] = beta[down]
        beta[down] = (beta[down] + low[down]) / 2
    return beta, z


def neighbourhoods(points: DataFrame, q: int, near: DataFrame | None = None) -> DataFrame:
    """(id, near, lq): the ``q`` least squared distances in order, itself first, and the one after them; from ``near`` if they are known."""
    near = nearest(points, q + 1) if near is None else near.where(F.col("rank") <= q + 1)
    listed = near.groupBy(F.col("i").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "sqdist"))).alias("l"))
    values = F.transform("l", lambda s: s["sqdist"])
    return listed.select("id", F.slice(values, 1, q).alias("near"), F.element_at(values, -1).alias("lq"))


def calibrate(points: DataFrame, ppx: int | list[int], xppx: float = 3.0, n: int | None = None) -> DataFrame:
    """(id, ppx, beta, znorm, lq) of points of any kind, for one perplexity or several; znorm is twice Z.

    Neighbourhoods of a smaller perplexity are the front of those of the largest, so neighbours are looked for once.
    """
    wanted, near = [ppx] if isinstance(ppx, int) else ppx, None
    if n is None and kind_of(points) == "distances":  # points are counted by their neighbours, not by all pairs once more
        near = written(nearest(points, int(xppx * max(wanted) + 1) + 1))
        n = near.where("rank = 1").count()
    n = count_of(points) if n is None else n
    sizes = {p: q_nn(n, p, xppx) for p in wanted}

    def run(frames):
        for f in frames:
            if len(f):
                near = np.stack([np.append(a, b) for a, b in zip(f["near"], f["lq"])])
                for p, q in sizes.items():
                    beta, z = solve(near[:, :q], near[:, q], p, xppx)
                    yield pd.DataFrame({"id": f["id"], "ppx": p, "beta": beta, "znorm": 2 * z, "lq": near[:, q]})

    return neighbourhoods(points, max(sizes.values()), near).mapInPandas(run, "id bigint, ppx int, beta double, znorm double, lq double")


def entropy_at(points: DataFrame, q: int, beta: float) -> DataFrame:
    """(id, z, h) at one precision, by Spark's own functions."""
    near = neighbourhoods(points, q)
    z = F.aggregate("near", F.lit(-1.0), lambda a, d: a + F.exp(-beta * d))
    s = F.aggregate("near", F.lit(0.0), lambda a, d: a + d * F.exp(-beta * d))
    return near.select("id", z.alias("z"), s.alias("s")).select("id", "z", F.when(F.col("z") > 1, beta * F.col("s") / F.col("z") + F.log("z")).otherwise(F.lit(0.0)).alias("h"))
