"""Nearest neighbours, exactly, by comparing only cells of points that can be near each other.

Some points serve as pivots, and each point is in the cell of its nearest one. Of each cell the least and greatest distance
to every pivot are kept, and how far its points are at least from the plane midway to every other pivot. By the triangle
inequality, and by adding both cells' gaps to the plane between them, two cells have a lower bound of any distance across.

Points are first compared within their own cell (and, where it has too few, the cells around), which gives each a k-th
distance so far. Then only cells whose bound is not above it are joined, and within a joined pair only those points take
part whose own bound, from their distance to the other pivot, is not above their own k-th distance. Nothing else is left
out, so the result is that of all pairs; ties are kept until the last ranking, which settles them by id.

Pivots are one for about ``CELL`` points, at most ``PIVOTS``, so what the driver sees is a table of cells against cells. A cell is cut into blocks of at
most about ``BLOCK`` points by id hash. A task holds a group of blocks, at most ``GROUP`` points, with their neighbours so far, and the
blocks that they meet pass by one after the other (``streamed``); what comes back is k rows a point.
Within one cell, and where everything is equally far from everything, the work stays that of all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.session import batches_of, checkpointed, written

from .pairs import BLOCK, block_size, both_ways, count_of, ids_of, kind_of, sparse_block, sqdist, streamed, whole

PIVOTS, CELL = 256, 250


def _column(x: pa.Array):
    """The points of an Arrow column: a matrix, or (sizes, keys, values)."""
    if isinstance(x, pa.MapArray):
        ends = x.offsets.to_numpy()
        return np.diff(ends), x.keys.to_numpy()[ends[0] : ends[-1]], x.items.to_numpy()[ends[0] : ends[-1]]
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _block(sizes, keys, flat):
    """The points of a gathered block."""
    return np.asarray(flat, dtype=float).reshape(len(sizes), -1) if keys is None else (np.asarray(sizes), keys, flat)


def _some(points, keep: np.ndarray):
    if isinstance(points, tuple):
        sizes, keys, values = points
        on = np.repeat(keep, sizes)
        return sizes[keep], np.asarray(keys)[on], np.asarray(values)[on]
    return points[keep]


def _across(a, b) -> np.ndarray:
    return sparse_block(a, b) if isinstance(a, tuple) else sqdist(a, b)


class Distance:
    """Pairs by squared distance, the point itself first."""

    columns: tuple[str, ...] = ()
    own = -1.0  # a point's value with itself; None: as computed

    def least(self, sq, left, right):
        """The least value at a squared distance of ``sq`` or more; ``right`` has the least of each column."""
        return sq

    def values(self, sq, left, right):
        """The values of a table of squared distances, or of a list of them with as many entries on either side."""
        return sq

    def radius(self, most, left, right):
        """The greatest squared distance at which the least value is not above ``most``."""
        return most


class Plain(Distance):
    own = None


class Mutual(Distance):
    """Pairs by the sum of both ends' kernels, the greatest first; points are no partners of themselves."""

    columns = ("beta", "znorm")
    own = np.inf

    def least(self, sq, left, right):
        with np.errstate(divide="ignore", invalid="ignore"):
            return -(np.exp(-left[0] * sq) / left[1] + np.exp(-right[0] * sq) / right[1]) * (1 + 1e-9)

    def values(self, sq, left, right):
        if sq.ndim == 2:
            left, right = [c[:, None] for c in left], [c[None] for c in right]
        with np.errstate(divide="ignore", invalid="ignore"):
            one, two = np.exp(-left[0] * sq) / left[1], np.exp(-right[0] * sq) / right[1]
        return -(np.nan_to_num(one, posinf=0) + np.nan_to_num(two, posinf=0))

    def radius(self, most, left, right):
        low, high = np.zeros(len(most)), np.ones(len(most))
        for _ in range(200):
            more = ~(self.least(high, left, right) > most)
            if not more.any():
                break
            low[more], high[more] = high[more], 2 * high[more]
        for _ in range(30):
            middle = (low + high) / 2
            more = ~(self.least(middle, left, right) > most)
            low, high = np.where(more, middle, low), np.where(more, high, middle)
        return np.where(~(self.least(high, left, right) > most), np.inf, high)


@dataclass
class Cells:
    """Pivots, and what is known of their cells; ``bound`` is the least distance across, ``blur`` what rounding may take off it."""

    pivots: object
    counts: np.ndarray
    between: np.ndarray
    reach: np.ndarray
    gap: np.ndarray
    bound: np.ndarray
    blur: float

    def of_points(self, d: np.ndarray, own: int, other: int) -> np.ndarray:
        """Lower bounds of the distances of points of cell ``own`` to all of ``other``, from ``d``, squared, to both pivots."""
        ring = np.sqrt(d[:, 1]) - self.reach[other]
        far = self.between[own, other]
        plane = (d[:, 1] - d[:, 0]) / (2 * far) + self.gap[other, own] if far > 0 else 0.0
        return np.maximum(np.maximum(ring, plane) - self.blur, 0.0)


def _pick(points: DataFrame, many: int):
    """``many`` points by the order of their hashes, as a matrix or (sizes, keys, values)."""
    rows = whole(points).orderBy(F.xxhash64("id"), "id").limit(many).toPandas()  # at most ``PIVOTS`` rows
    if kind_of(points) == "dense":
        return np.stack(rows["x"].to_numpy()).astype(float)
    maps = [dict(m) for m in rows["x"]]
    return np.array([len(m) for m in maps]), np.array([k for m in maps for k in m], np.int64), np.array([v for m in maps for v in m.values()], float)


def in_cells(points: DataFrame, pivots, columns: tuple[str, ...] = ()) -> DataFrame:
    """(id, x, ..., cell) of points that have a place."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                near = _across(pivots, _column(b.column("x"))).argmin(axis=0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=[*b.schema.names, "cell"])

    source = whole(points).select("id", "x", *columns)
    return source.mapInArrow(run, source.withColumn("cell", F.lit(0)).schema)


def cells_of(placed: DataFrame, pivots, many: int) -> Cells:
    """Summaries of the cells of ``in_cells``: at most ``many`` squared rows come to the driver."""
    between = np.sqrt(_across(pivots, pivots))
    with np.errstate(divide="ignore"):
        half = np.where(between > 0, 1 / (2 * between), 0.0)

    def run(batches):
        n = np.zeros(many, np.int64)
        low, high, gap = np.full((many, many), np.inf), np.zeros((many, many)), np.full((many, many), np.inf)
        norm = 0.0
        for b in batches:
            if b.num_rows:
                x, cell = _column(b.column("x")), b.column("cell").to_numpy()
                d = _across(pivots, x).T
                norm = max(norm, float((np.bincount(np.repeat(np.arange(len(x[0])), x[0]), x[2] ** 2) if isinstance(x, tuple) else (x * x).sum(axis=1)).max(initial=0)))
                for c in np.unique(cell):
                    own = d[cell == c]
                    root = np.sqrt(own)
                    n[c] += len(own)
                    low[c], high[c] = np.minimum(low[c], root.min(axis=0)), np.maximum(high[c], root.max(axis=0))
                    gap[c] = np.minimum(gap[c], ((own - own[:, c : c + 1]) * half[c]).min(axis=0))
        for c in np.flatnonzero(n):
            yield pd.DataFrame({"cell": c, "pivot": np.arange(many), "n": n[c], "low": low[c], "high": high[c], "gap": gap[c], "norm": norm}).pipe(pa.RecordBatch.from_pandas, preserve_index=False)

    parts = placed.select("x", "cell").mapInArrow(run, "cell bigint, pivot bigint, n bigint, low double, high double, gap double, norm double")
    t = parts.groupBy("cell", "pivot").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("gap").alias("gap"), F.max("norm").alias("norm")).toPandas()
    low, high, gap, counts = np.zeros((many, many)), np.full((many, many), np.inf), np.zeros((many, many)), np.zeros(many, np.int64)
    at = (t["cell"].to_numpy(), t["pivot"].to_numpy())
    low[at], high[at], gap[at], counts[at[0]] = t["low"], t["high"], t["gap"], t["n"]
    apart = np.maximum(gap + gap.T, 0.0)
    for p in range(many):  # rings around each pivot
        ring = low[:, p][:, None] - high[:, p][None, :]
        apart = np.maximum(apart, np.maximum(ring, ring.T))
    np.fill_diagonal(apart, 0.0)
    blur = 1e-7 * max(float(high[np.isfinite(high)].max(initial=0.0)), float(np.sqrt(t["norm"].max())) if len(t) else 0.0)
    return Cells(pivots, counts, between, np.diagonal(high).copy(), gap, np.maximum(apart - blur, 0.0), blur)


def _gathered(dealt: DataFrame, sparse: bool, *more: str) -> DataFrame:
    """(b, ids, sizes, keys, flat, ...) of ``dealt(b, id, x, ...)``: a row a block, its points in order of id."""
    keys, values = (F.map_keys("x"), F.map_values("x")) if sparse else (F.lit(None).cast("array<int>"), F.col("x"))
    rows = F.sort_array(F.collect_list(F.struct("id", keys.alias("k"), values.alias("v"), *more)))
    packed = dealt.groupBy("b").agg(F.first("cell").alias("cell"), rows.alias("r"))
    sizes = F.transform("r", lambda s: F.size(s["v"]))
    return packed.select("b", "cell", F.col("r.id").alias("ids"), sizes.alias("sizes"), F.flatten("r.k").alias("keys"), F.flatten("r.v").alias("flat"), *[F.col(f"r.{c}").alias(c) for c in more])


class _Best:
    """A block of points, and of each what is known of its first ``k``: candidates wait until there are as many as are kept."""

    def __init__(self, r, measure: Distance, k: int, centre):
        self.x, self.ids, self.cell, self.theta, self.k = _block(r.sizes, r.keys, r.flat), np.asarray(r.ids), r.cell, np.array(r.theta, float), k
        self.columns = [np.asarray(getattr(r, c)) for c in measure.columns]
        self.near = None if centre is None else _augmented(self.x - centre)
        self.waiting, self.many, self.cells = [], 0, {}

    def add(self, row, other, sq, value) -> None:
        self.waiting.append((row, other, sq, value))
        self.many += len(row)
        if self.many > 2 * self.k * len(self.ids):
            self.settle()

    def settle(self):
        """(row, other, sqdist, value) of the first so far, and the bound that they give."""
        if not self.waiting:
            return None
        row, other, sq, value = (np.concatenate(c) for c in zip(*self.waiting))
        order = np.lexsort((other, value, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = order[place < self.k]
        last = order[place == self.k - 1]
        row = row[place < self.k]
        self.waiting = [(row, other[keep], sq[keep], value[keep])]
        self.many = len(row)
        full = np.flatnonzero(np.bincount(row, minlength=len(self.ids)) == self.k)
        self.theta[full] = np.minimum(self.theta[full], value[last])
        return self.waiting[0]


def _augmented(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, lengths): points in single precision with their squared lengths, for distances by one product of matrices."""
    norm = np.einsum("ij,ij->i", x, x)
    with np.errstate(over="ignore"):
        return np.hstack([x, norm[:, None], np.ones((len(x), 1))]).astype(np.float32), np.sqrt(norm)


def _likely(near: np.ndarray, length: np.ndarray, radius: np.ndarray, right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Places, in the table of all pairs, of those whose distance may be up to ``radius``: single precision, less all that it can be wrong by."""
    with np.errstate(over="ignore", invalid="ignore"):
        blur = (near.shape[1] + 8) * 2.0**-22 * (length + right[1].max(initial=0.0)) ** 2
        most = ((radius + blur) * (1 + 1e-6)).astype(np.float32)
        return np.flatnonzero(~(near @ right[0].T > most[:, None]))


#: Candidates whose distances a task computes at once, and the share of a table of pairs from which all of it is computed.
CHUNK, SHARE = 1 << 16, 32


def _compared(left: DataFrame, right: DataFrame, pairs: DataFrame, shape: tuple[int, int], cells: Cells, lows: np.ndarray, measure: Distance, k: int, computed: Accumulator | None) -> DataFrame:
    """(i, j, sqdist, value), written: of the pairs of blocks ``pairs(b, b2)`` what may be among each left point's first ``k``.

    ``shape``: blocks of the left side, and points. A task holds a group of left blocks and their candidates, and right blocks pass
    by. Distances are first told by a product of matrices in single precision, and computed from differences where that does not
    rule a pair out, so the result is that of computing all.
    """
    dense = not isinstance(cells.pivots, tuple)
    centre = cells.pivots.mean(axis=0) if dense else None

    def meet(own: _Best, r, other: np.ndarray, points, theirs: list, flipped) -> None:
        x, theta, ours, on = own.x, own.theta, own.columns, np.arange(len(own.ids))
        if own.cell != r.cell and np.isfinite(theta).any():
            if r.cell not in own.cells:
                d = [_across(_some(cells.pivots, np.arange(len(cells.counts)) == c), x).T for c in (own.cell, r.cell)]
                own.cells = {r.cell: cells.of_points(np.hstack(d), own.cell, r.cell) ** 2}
            keep = measure.least(own.cells[r.cell], ours, lows[r.cell]) <= theta
            if not keep.any():
                return
            on, x, theta, ours = np.flatnonzero(keep), _some(x, keep), theta[keep], [c[keep] for c in ours]
        if computed is not None:
            computed.add(len(on) * len(other))
        if dense and np.isfinite(theta).all():
            at = _likely(own.near[0][on] * flipped[0], own.near[1][on], measure.radius(theta, ours, lows[r.cell]), flipped[1])
            if len(at) * SHARE <= len(on) * len(other):
                for some in (at[a : a + CHUNK] for a in range(0, len(at), CHUNK)):
                    i, j = np.divmod(some, len(other))
                    d = x[i] - points[j]
                    sq = np.einsum("ij,ij->i", d, d)
                    v = measure.values(sq, [c[i] for c in ours], [c[j] for c in theirs])
                    if measure.own is not None:
                        v = np.where(own.ids[on[i]] == other[j], measure.own, v)
                    hit = (v <= theta[i]) & (v < np.inf)
                    own.add(on[i[hit]], other[j[hit]], sq[hit], v[hit])
                return
        sq = _across(x, points)
        v = measure.values(sq, ours, theirs)
        if measure.own is not None:
            v = np.where(own.ids[on][:, None] == other[None, :], measure.own, v)
        most = theta if v.shape[1] <= k else np.minimum(theta, np.partition(v, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero((v <= most[:, None]) & (v < np.inf))
        own.add(on[i], other[j], sq[i, j], v[i, j])

    def run(frames):
        group, held = None, {}

        def given():
            for own in held.values():
                if (got := own.settle()) is not None:
                    yield pd.DataFrame({"i": own.ids[got[0]], "j": got[1], "sqdist": got[2], "value": got[3]})

        for f in frames:
            for r in f.itertuples(index=False):
                if r.g != group:
                    yield from given()
                    group, held = r.g, {}
                if not r.side:
                    held[r.b] = _Best(r, measure, k, centre)
                    continue
                points, other, theirs = _block(r.sizes, r.keys, r.flat), np.asarray(r.ids), [np.asarray(getattr(r, c)) for c in measure.columns]
                flipped = None
                if dense:
                    rows, lengths = _augmented(points - centre)
                    sign = np.full(rows.shape[1], -2.0, np.float32)
                    sign[-2:] = 1
                    flipped = sign, (np.hstack([rows[:, :-2], rows[:, :-3:-1]]), lengths)
                for b in r.asked:
                    meet(held[b], r, other, points, theirs, flipped)
        yield from given()

    with batches_of(left.sparkSession, 16 << 20):
        return written(streamed(left, right, *shape, pairs).mapInPandas(run, "i bigint, j bigint, sqdist double, value double"))


def ranked(points: DataFrame, k: int, measure: Distance, block: int = BLOCK, of: DataFrame | None = None, pivots: int | None = None, computed: Accumulator | None = None) -> DataFrame:
    """(i, j, sqdist, value, rank): the first ``k`` partners of each point, or of each of the points ``of``, by ``measure``.

    Points are dense or sparse, with the measure's columns. ``computed`` counts the distances computed between points.
    """
    spark, sparse, n = points.sparkSession, kind_of(points) == "sparse", count_of(points)
    if not n:
        return spark.createDataFrame([], "i bigint, j bigint, sqdist double, value double, rank int")
    order = Window.partitionBy("i").orderBy("value", "j")
    many = min(PIVOTS, n // CELL) if pivots is None else min(pivots, n)
    rounds = ["block", "home", "rest"]
    if many < 8 or 2 * k >= n:  # too few points to leave any out
        many, rounds, block = 1, ["all"], block_size(points, n, block)
    chosen = _pick(points, many)
    placed = checkpointed(in_cells(points, chosen, measure.columns))
    cells = cells_of(placed, chosen, many)
    lows = np.zeros((many, len(measure.columns)))
    if measure.columns:
        for r in placed.groupBy("cell").agg(*[F.min(c).alias(c) for c in measure.columns]).collect():  # a row a cell
            lows[r["cell"]] = [r[c] for c in measure.columns]
    parts = np.maximum(1, -(-cells.counts // block))
    starts = np.concatenate(([0], np.cumsum(parts)))

    def by_cell(values) -> Column:
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)

    def dealt(p: DataFrame) -> DataFrame:
        return p.withColumn("b", by_cell(starts[:-1]) + F.pmod(F.xxhash64("id"), by_cell(parts)).cast("int"))

    def first(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    right = _gathered(dealt(placed), sparse, *measure.columns)
    asked = placed if of is None else in_cells(of, chosen, measure.columns)
    used = [int(c) for c in np.flatnonzero(cells.counts)]
    blocks = spark.createDataFrame([(int(b), c) for c in used for b in range(starts[c], starts[c + 1])], "b2 int, cell2 int")
    # Cells in which a point finds k others to begin with: its own, and the nearest ones while there are too few.
    home: dict[int, set[int]] = {}
    for c in used:
        around = np.argsort(np.where(np.arange(many) == c, -1.0, cells.between[c]), kind="stable")
        home[c] = {int(o) for o in around[: 1 + int(np.searchsorted(np.cumsum(cells.counts[around]), k + 1))]}
    rows = [(a, b, float(measure.least(cells.bound[a, b] ** 2, lows[a], lows[b])), b in home[a]) for a in used for b in used]
    across = spark.createDataFrame(rows, "cell int, cell2 int, least double, home boolean")  # cells against cells
    best = None
    for step in rounds:
        if step == "home" and (parts == 1).all():
            continue  # blocks are cells, and all of home is done
        if best is None:
            left = dealt(asked).withColumn("theta", F.lit(float("inf")))
        else:
            far = best.where(F.col("rank") == k).select(F.col("i").alias("id"), F.col("value").alias("far"))
            left = dealt(asked).join(far, "id", "left").withColumn("theta", F.coalesce("far", F.lit(float("inf")))).drop("far")
        heads = left.groupBy("b", "cell").agg(F.max("theta").alias("theta"))
        pairs = heads.join(F.broadcast(across), "cell").join(F.broadcast(blocks), "cell2")
        begun = F.col("home") & ((by_cell(parts) == 1) | (F.col("b") == F.col("b2")))
        if step == "block":
            pairs = pairs.where(begun)
        elif step == "home":
            pairs = pairs.where(F.col("home") & ~begun)
        elif step == "rest":
            pairs = pairs.where(~F.col("home") & ~(F.col("least") > F.col("theta")))
        found = _compared(_gathered(left, sparse, *measure.columns, "theta"), right, pairs.select("b", "b2"), (int(starts[-1]), n), cells, lows, measure, k, computed)
        best = first(found if best is None else best.drop("rank").unionByName(found))
        best = best if step == rounds[-1] else checkpointed(best)
    return best


def nearest(points: DataFrame, k: int, block: int = BLOCK, of: DataFrame | None = None, self_first: bool = True, pivots: int | None = None, computed: Accumulator | None = None) -> DataFrame:
    """(i, j, sqdist, rank): the ``k`` nearest of each point, or of each of the points ``of``, itself included; ties go by id.

    The point itself is at distance 0 and comes first, with ``self_first`` also before others at that distance.
    """
    if kind_of(points) != "distances":
        return ranked(points, k, Distance() if self_first else Plain(), block, of, pivots, computed).select("i", "j", "sqdist", "rank")
    order = Window.partitionBy("i").orderBy(F.col("sqdist"), *([F.col("i") != F.col("j")] if self_first else []), F.col("j"))
    given = points.where("i is not null and j is not null").select(*[F.col(c).cast("bigint").alias(c) for c in "ij"], F.col("sqdist").cast("double").alias("sqdist"))
    given = given.withColumn("value", F.when(F.col("i") == F.col("j"), -1.0).otherwise(F.col("sqdist")))
    rows = foremost(given, ["i"], [], k + 1, both=True)  # with a point itself, where the table has it
    rows = written(rows if of is None else rows.join(ids_of(of).select(F.col("id").alias("i")), "i", "left_semi"))
    own = rows.select("i", F.col("i").alias("j"), F.lit(0.0).alias("sqdist")).distinct()
    found = rows.where("i <> j").select("i", "j", "sqdist").unionByName(own).repartition("i").groupBy("i", "j").agg(F.min("sqdist").alias("sqdist"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Rows that a task of ``foremost`` holds, at most and to begin with, and keys whose bounds it remembers.
HELD, FIRST, SLOTS = 4_000_000, 1 << 19, 1 << 20


def foremost(rows: DataFrame, keys: list[str], ties: list[str], k: int, both: bool = False) -> DataFrame:
    """Of ``rows(*keys, j, value, ...)`` all those that may be among the first ``k`` by value, then ``ties``, then j, of their keys, a j once.

    Every task leaves out what its own rows rule out, so of a table of all pairs little has to move; the caller ranks the rest. A task
    holds some ``HELD`` rows, and gives away what it has when they do not get fewer; the bounds that it found stay. With ``both`` each
    row counts with i and j exchanged too.
    """
    swapped = [{"i": "j", "j": "i"}.get(c, c) for c in rows.columns]

    def run(batches):
        theta, owner = np.full(SLOTS, np.inf), np.zeros((len(keys), SLOTS), np.int64)
        held, many, most = [], 0, min(HELD, FIRST)

        def slots(columns):
            mixed = np.zeros(len(columns[0]), np.uint64)
            for c in columns:
                mixed = (mixed ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            return (mixed >> np.uint64(44)).astype(np.int64)

        def best():
            t = pa.Table.from_batches(held).combine_chunks()
            of, j, value = [t[c].to_numpy().astype(np.int64) for c in keys], t["j"].to_numpy(), t["value"].to_numpy()

            def starts(order, columns):
                new = np.ones(len(order), bool)
                new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
                return new

            def first(order):
                """The first ``k`` of each key, of ``order`` or of all, and their places from 0."""
                back = slice(None) if order is None else order
                done = np.lexsort((j[back], *[t[c].to_numpy()[back] for c in reversed(ties)], value[back], *[c[back] for c in of]))
                done = done if order is None else order[done]
                new = starts(done, of)
                place = np.arange(len(done)) - np.flatnonzero(new)[np.cumsum(new) - 1]
                return done[place < k], place[place < k]

            order, place = first(None)
            some = order[np.lexsort((j[order], *[c[order] for c in of]))]
            if not starts(some, [*of, j]).all():  # a partner given more than once counts by its least value
                order = np.lexsort((value, j, *of))
                order, place = first(order[starts(order, [*of, j])])
            last = order[place == k - 1]
            at = slots([c[last] for c in of])
            for n, c in enumerate(of):
                owner[n, at] = c[last]
            theta[at] = value[last]
            return t.take(pa.array(order)).to_batches()

        def each():
            for b in batches:
                yield b
                if both:
                    yield pa.RecordBatch.from_arrays([b.column(c) for c in swapped], schema=b.schema)

        for b in each():
            of, value = [b.column(c).to_numpy(zero_copy_only=False) for c in keys], b.column("value").to_numpy(zero_copy_only=False)
            at = slots(of)
            out = value > theta[at]
            for n, c in enumerate(of):
                out &= owner[n, at] == c
            if not out.all():
                held.append(b.filter(pa.array(~out)))
                many += held[-1].num_rows
            if many > most:
                held = best()
                many = sum(h.num_rows for h in held)
                most = min(HELD, max(FIRST, 2 * many))
                if 2 * many > HELD:
                    yield from held
                    held, many = [], 0
        if held:
            yield from best()

    return rows.mapInArrow(run, rows.schema)


def partners(points: DataFrame, betas: DataFrame, size: int, block: int = BLOCK, pivots: int | None = None, computed: Accumulator | None = None) -> DataFrame:
    """(i, j, sqdist): the ``size`` best partners of each point by the sum of both ends' kernels; ties go by id."""
    b = betas.select("id", "beta", "znorm")
    if kind_of(points) != "distances":
        return ranked(points.join(b, "id"), size, Mutual(), block, None, pivots, computed).select("i", "j", "sqdist")
    both = both_ways(points).where("i <> j").join(b.toDF("i", "bi", "zi"), "i").join(b.toDF("j", "bj", "zj"), "j")
    score = kernel("bi", "zi") + kernel("bj", "zj")
    some = foremost(both.select("i", "j", "sqdist", (-score).alias("value")), ["i"], [], size)
    found = some.repartition("i").groupBy("i", "j").agg(F.min("sqdist").alias("sqdist"), F.min("value").alias("value"))
    return found.withColumn("o", F.row_number().over(Window.partitionBy("i").orderBy("value", "j"))).where(F.col("o") <= size).select("i", "j", "sqdist")


def kernel(beta: str, znorm: str) -> Column:
    """The kernel of one end of a pair, 0 where its mass is."""
    return F.coalesce(F.try_divide(F.exp(-F.col(beta) * F.col("sqdist")), F.col(znorm)), F.lit(0.0))


def q_nn(n: int, ppx: int, xppx: float = 3.0) -> int:
    """The order statistic that bounds a point's neighbourhood."""
    return min(int(xppx * ppx + 1), n - 1)


def nn_quantile(points: DataFrame, q: int) -> DataFrame:
    """(id, lq): the squared distance at position ``q`` of each point's sorted distances, position 0 being itself."""
    return nearest(points, q + 1).where(F.col("rank") == q + 1).select(F.col("i").alias("id"), F.col("sqdist").alias("lq"))


def within_bound(points: DataFrame, q: int, size: int) -> DataFrame:
    """(i, j, sqdist): of the others no farther than the bound of i, the first ``size`` in order of id."""
    near = nearest(points, q + 1).where("i <> j")
    first = Window.partitionBy("i").orderBy("j")
    return near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= size).select("i", "j", "sqdist")
