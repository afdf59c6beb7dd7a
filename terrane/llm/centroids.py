"""Centroid clustering of integer vectors by sort-means (Phillips 2002).

Each round knows the distances between centroids, and for every centroid the others in order of their distance from it.
A vector starts at the centroid that it was given last, at distance d, and walks along that centroid's order; once a
centroid lies strictly beyond 2 d from the start, it and all after it are farther from the vector than the start is, so
the walk ends. At exactly 2 d a tie is possible, hence "strictly"; ties go to the smaller number. Squares of integers
are compared, so nothing is rounded.

A task walks with many vectors at once, those of one start together. Centroids (``k`` rows) go to the tasks; sums and
counts come back by cluster after a partial aggregation; each round's assignment is written below the shared folder.

Cases: vectors of another length than ``dims``, or with a null, NaN or infinite component, are left out. Equal vectors are
rows of their own. Fewer than ``k`` vectors make as many centroids as there are; none give no rows. An empty centroid stays
where it is. A null id hashes as an empty one. A component beyond ``BOUND`` after scaling would not leave room for
squared distances in 64 bits: the job fails and names the vector.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

BOUND = 1 << 27


def quantised(vectors: DataFrame, id_col: str, column: str, dims: int = 64, scale: float = 64.0) -> DataFrame:
    """(id, x): the vectors that can be used, each component as floor(scale * component)."""
    x = F.transform(column, lambda v: v.cast("double"))
    good = (F.size(column) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fits = F.forall(x, lambda v: F.abs(v * scale) < BOUND)
    whole = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    refused = F.raise_error(F.concat(F.lit("vector with a component out of range: id "), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))).cast("array<bigint>")
    return vectors.where(good).select(F.col(id_col).alias("id"), F.when(fits, whole).otherwise(refused).alias("x"))


def walk(x: np.ndarray, start: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest, squared distance, distances computed) of each row of ``x``, walking from centroid ``start``."""
    between = ((centroids[:, None] - centroids[None]) ** 2).sum(axis=2)
    best, dist, computed = start.copy(), np.empty(len(x), np.int64), len(x)
    for c in np.unique(start):
        rows = np.flatnonzero(start == c)
        own = dist[rows] = ((x[rows] - centroids[c]) ** 2).sum(axis=1)
        for other in np.argsort(between[c], kind="stable"):
            if other == c:
                continue
            on = between[c, other] <= 4 * own
            rows, own = rows[on], own[on]  # distances from c rise, so who stops has stopped for good
            if not len(rows):
                break
            d = ((x[rows] - centroids[other]) ** 2).sum(axis=1)
            computed += len(rows)
            better = (d < dist[rows]) | ((d == dist[rows]) & (other < best[rows]))
            dist[rows[better]], best[rows[better]] = d[better], other
    return best, dist, computed


def assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``points(id, x, cluster)`` with the cluster of these centroids in place of the old one, and ``distance``."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
                best, dist, _ = walk(x, b.column("cluster").to_numpy().astype(np.int64), centroids)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(best.astype(np.int32)), pa.array(dist)], names=["id", "x", "cluster", "distance"])

    source = points.select("id", "x", "cluster")
    return source.mapInArrow(run, source.withColumn("distance", F.lit(0).cast("long")).schema)


def sort_means(spark: SparkSession, points: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(id, x, cluster, distance) of ``points(id, x array<bigint>)`` after ``rounds`` updates, and the centroids.

    The start: the ``k`` points whose hash of "seed:id" is smallest, in its order.
    """
    scratch = Scratch(spark, "centroids")
    points = scratch.write(points.withColumn("cluster", F.lit(0)))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = points.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    if not first:
        return points.withColumn("distance", F.lit(0).cast("long")), np.empty((0, 0), np.int64)
    centroids = np.array([r["x"] for r in first], np.int64)
    for _ in range(rounds):
        given = scratch.write(assigned(points, centroids))
        scratch.drop(points)
        points = given
        sums = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(centroids.shape[1])])
        centroids = centroids.copy()
        for r in sums.collect():  # a row a cluster
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    out = scratch.write(assigned(points, centroids))
    scratch.drop(points)
    return out, centroids


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    given, centroids = sort_means(spark, points)
    spread = {r["cluster"]: r["s"] for r in given.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    told = [(c, s, sum(spread.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in spread.items()]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return given.join(F.broadcast(told), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
