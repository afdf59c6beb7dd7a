"""Squared distances of dense points, sparse points or a table of distances.

All-pairs work on points is dealt out as groups of blocks of points, each a task, by which the other blocks pass (``streamed``).
Neighbours are in ``neighbours``.

Points with a null vector, or a null in it, cannot be placed and are refused by name rather than inside a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, SLAB = 2048, 1024


def kind_of(points: DataFrame) -> str:
    """``dense`` (id, x array), ``sparse`` (id, x map) or ``distances`` (i, j, sqdist)."""
    if "sqdist" in points.columns:
        return "distances"
    return "sparse" if isinstance(points.schema["x"].dataType, T.MapType) else "dense"


def ids_of(points: DataFrame) -> DataFrame:
    """(id) of points of any kind, each once."""
    if kind_of(points) == "distances":
        return points.select(F.col("i").alias("id")).unionByName(points.select(F.col("j").alias("id"))).distinct()
    return points.select("id")


def count_of(points: DataFrame) -> int:
    return ids_of(points).count()


def whole(points: DataFrame) -> DataFrame:
    """``points``, failing with a message on the first one that has no place."""
    if kind_of(points) == "dense":
        bad = F.col("x").isNull() | F.exists("x", lambda v: v.isNull())
    else:
        bad = F.col("x").isNull() | F.exists(F.map_values("x"), lambda v: v.isNull())
    return points.withColumn("x", F.when(~bad, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("point without a place: id "), F.coalesce(F.col("id").cast("string"), F.lit("null")))).cast(points.schema["x"].dataType)))


def block_size(points: DataFrame, n: int, most: int = BLOCK) -> int:
    """Points a block: at most ``most``, and fewer where so few blocks would leave cores without a pair."""
    cores = points.sparkSession.sparkContext.defaultParallelism
    return int(max(1, min(most, -(-n // max(1, round((2 * cores) ** 0.5))))))


def block_matrices(points: DataFrame, blocks: int) -> DataFrame:
    """(b, ids, sizes, keys, flat): points gathered into blocks by id hash, keys and values as one flat array each.

    Keys are null for dense points, whose vectors all have the length ``sizes[0]``.
    """
    sparse = kind_of(points) == "sparse"
    keys, values = (F.map_keys("x"), F.map_values("x")) if sparse else (F.lit(None).cast("array<int>"), F.col("x"))
    dealt = whole(points).select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), "id", keys.alias("k"), values.alias("v"))
    rows = F.sort_array(F.collect_list(F.struct("id", "k", "v")))
    packed = dealt.groupBy("b").agg(rows.alias("r"))
    return packed.select("b", F.col("r.id").alias("ids"), F.transform("r", lambda s: F.size(s["v"])).alias("sizes"), F.flatten("r.k").alias("keys"), F.flatten("r.v").alias("flat"))


#: Points of one side that a task of ``streamed`` holds at most.
GROUP = 65_536


_keys: dict[int, list[int]] = {}


def partition_keys(spark, many: int) -> list[int]:
    """A number for each of ``many`` hash partitions that lands in it; the same in every session."""
    if many in _keys:
        return _keys[many]
    at = spark.range(32 * many + 32).select("id", F.pmod(F.hash("id"), F.lit(many)).alias("p"))
    found = {r["p"]: r["id"] for r in at.groupBy("p").agg(F.min("id").alias("id")).collect()}  # a row a partition
    return _keys.setdefault(many, [found.get(p, -1 - p) for p in range(many)])


def streamed(left: DataFrame, right: DataFrame, blocks: int, points: int, met: DataFrame | None = None) -> DataFrame:
    """(g, side, b, ..., asked): groups of blocks of ``left`` (side 0), each followed by the blocks of ``right`` that it meets, in partitions of their own.

    A group is a task, which holds its own blocks and sees the others one after the other. The right side moves once for
    each group, and there is a fixed number of groups up to ``GROUP`` points in each, so what moves grows with the points and
    not with pairs of blocks. ``met(b, b2)`` says which blocks meet; ``asked`` has the left ones that a right one is for.
    """
    spark = left.sparkSession
    groups = max(1, min(blocks, max(2 * spark.sparkContext.defaultParallelism, -(-points // GROUP))))
    keys = F.array(*[F.lit(int(k)).cast("bigint") for k in partition_keys(spark, groups)])
    g = F.element_at(keys, (F.col("b").cast("bigint") * groups / blocks).cast("int") + 1)
    held = left.withColumns({"g": g, "side": F.lit(0)})
    if met is None:
        sent = right.crossJoin(spark.range(groups).select(F.element_at(keys, (F.col("id") + 1).cast("int")).alias("g"))).withColumn("asked", F.lit(None).cast("array<int>"))
    else:
        sent = right.join(met.withColumn("g", g).groupBy("g", F.col("b2").alias("b")).agg(F.collect_set(F.col("b").cast("int")).alias("asked")), "b")
    rows = held.unionByName(sent.withColumn("side", F.lit(1)), allowMissingColumns=True)
    return rows.repartition(groups, "g").sortWithinPartitions("g", "side", "b")


def _matrix(flat, m: int) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(-1, m)


def sqdist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows, by direct differences: sums of squares cancel and would lose digits."""
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        d = b - row
        out[i] = np.einsum("ij,ij->i", d, d)
    return out


def sparse_block(a: tuple, b: tuple) -> np.ndarray:
    """Squared distances of sparse rows (sizes, keys, values): |a|^2 + |b|^2 - 2 a.b, over ``SLAB`` keys at a time."""
    rows, norms = [], []
    for sizes, keys, values in (a, b):
        row, values = np.repeat(np.arange(len(sizes)), sizes), np.asarray(values, dtype=float)
        rows.append((row, np.asarray(keys, dtype=np.int64), values))
        norms.append(np.bincount(row, values**2, len(sizes)))
    used = np.intersect1d(rows[0][1], rows[1][1])
    dot = np.zeros((len(a[0]), len(b[0])))
    for at in range(0, len(used), SLAB):
        some, parts = used[at : at + SLAB], []
        for (row, keys, values), n in zip(rows, dot.shape):
            place = np.minimum(np.searchsorted(some, keys), len(some) - 1)
            hit = some[place] == keys
            part = np.zeros((n, len(some)))
            np.add.at(part, (row[hit], place[hit]), values[hit])
            parts.append(part)
        dot += parts[0] @ parts[1].T
    return np.maximum(norms[0][:, None] + norms[1][None, :] - 2 * dot, 0)


#: Rows of a block whose distances to another one are given at a time.
ROWS = 256


def _points(r):
    """The points of a gathered block: a matrix, or (sizes, keys, values)."""
    return _matrix(r.flat, r.sizes[0]) if r.keys is None else (np.asarray(r.sizes), np.asarray(r.keys), np.asarray(r.flat))


def _part(points, part: slice):
    if not isinstance(points, tuple):
        return points[part]
    ends = np.concatenate(([0], np.cumsum(points[0])))
    sizes = points[0][part]
    held = slice(ends[part.start], ends[part.start + len(sizes)])
    return sizes, points[1][held], points[2][held]


def _distances(a, b) -> np.ndarray:
    return sparse_block(a, b) if isinstance(a, tuple) else sqdist(a, b)


def pair_sqdist(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, j, sqdist) for i < j."""
    if kind_of(points) == "distances":
        return points.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "sqdist").dropDuplicates(["i", "j"])
    n, cores = points.count(), points.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // min(block, max(1, -(-n // (2 * cores))))))  # groups enough for all cores
    packed = block_matrices(points, blocks)
    # Of each two blocks one meets the other as it passes by, every block as many as any other.
    ahead = F.pmod(F.col("b2") - F.col("b"), F.lit(blocks))
    met = points.sparkSession.range(blocks * blocks).select(F.expr(f"cast(id div {blocks} as int)").alias("b"), F.pmod("id", F.lit(blocks)).cast("int").alias("b2"))
    met = met.where((2 * ahead < blocks) | (2 * ahead == blocks) & (F.col("b") < F.col("b2")))

    def run(frames):
        group, held = None, {}
        for f in frames:
            for r in f.itertuples(index=False):
                if r.g != group:
                    group, held = r.g, {}
                ids, x = np.asarray(r.ids), _points(r)
                if not r.side:
                    held[r.b] = ids, x
                    continue
                for b in filter(held.__contains__, r.asked):  # others have no points
                    own, y = held[b]
                    for part in (slice(k, k + ROWS) for k in range(0, len(own), ROWS)):
                        d = _distances(_part(y, part), x)
                        first, second = np.broadcast_arrays(own[part, None], ids[None, :])
                        keep = first < second if b == r.b else first != second
                        yield pd.DataFrame({"i": np.minimum(first, second)[keep], "j": np.maximum(first, second)[keep], "sqdist": d[keep]})

    return streamed(packed, packed, blocks, n, met).mapInPandas(run, "i bigint, j bigint, sqdist double")


def both_ways(given: DataFrame) -> DataFrame:
    """(i, j, sqdist) of a table of distances with each pair in both orders; the table is read once."""
    rows = F.array(F.struct(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "sqdist"), F.struct(F.col("j").cast("bigint").alias("i"), F.col("i").cast("bigint").alias("j"), "sqdist"))
    return given.where("i is not null and j is not null").select(F.inline(rows))


def sparse_sqdist(points: DataFrame) -> DataFrame:
    """(i, j, sqdist) for i < j of ``(id, x map<int,double>)``, by blocks like dense ones."""
    return pair_sqdist(points)


def over(value: Column, by: Column) -> Column:
    """A quotient that is 0 where all values are 0, as when data do not vary."""
    return F.coalesce(F.try_divide(value, by), F.lit(0.0))


def center_scale(points: DataFrame) -> DataFrame:
    """Each feature less its mean, then everything divided by the one largest absolute value; constant data become 0."""
    long = points.select("id", F.posexplode("x").alias("dim", "v"))
    means = long.groupBy("dim").agg(F.avg("v").alias("mean"))
    centred = long.join(F.broadcast(means), "dim").select("id", "dim", (F.col("v") - F.col("mean")).alias("v"))  # a row a feature
    top = centred.agg(F.max(F.abs("v")).alias("top"))
    return centred.join(F.broadcast(top)).select("id", "dim", over(F.col("v"), F.col("top")).alias("v"))


def normalised(points: DataFrame) -> DataFrame:
    """Points of any kind, scaled: dense ones centred too, sparse ones and distances divided by the largest."""
    kind = kind_of(points)
    if kind == "distances":
        top = points.agg(F.max("sqdist").alias("top"))
        return points.join(F.broadcast(top)).select("i", "j", over(F.col("sqdist"), F.col("top")).alias("sqdist"))
    if kind == "sparse":
        return scale_sparse(points)
    listed = F.array_sort(F.collect_list(F.struct("dim", "v")))
    return center_scale(points).groupBy("id").agg(F.transform(listed, lambda s: s["v"]).alias("x"))


def scale_distances(pairs: DataFrame) -> DataFrame:
    """Distances divided by the largest; they are not centred."""
    top = pairs.agg(F.max(F.abs("d")).alias("top"))
    return pairs.join(F.broadcast(top)).withColumn("d", over(F.col("d"), F.col("top"))).drop("top")


def scale_sparse(points: DataFrame) -> DataFrame:
    """Values of sparse points divided by the largest absolute value; keys stay."""
    top = points.agg(F.max(F.array_max(F.transform(F.map_values("x"), F.abs))).alias("top"))
    return points.join(F.broadcast(top)).select("id", F.transform_values("x", lambda k, v: over(v, F.col("top"))).alias("x"))


def label_factor(df: DataFrame, key: str, label: str) -> DataFrame:
    """(key, code): labels as 1..k in sorted order, ranked over the distinct labels."""
    distinct = df.select(F.col(label).alias("l")).where("l is not null").distinct()
    codes = distinct.withColumn("code", F.row_number().over(Window.orderBy("l")))
    return df.join(codes, F.col(label) == F.col("l"), "left").select(F.col(key), "code")
