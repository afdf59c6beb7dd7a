"""Drivers of the layouts: chunk-parallel t-SNE by epochs, and global t-SNE by iterations."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.neighbours import foremost, kernel, partners, within_bound
from terrane.operators.pairs import GROUP, block_matrices, block_size, both_ways, count_of, ids_of, kind_of, over, partition_keys, sparse_block, streamed
from terrane.session import batches_of, checkpointed, dropped, in_place, written
from terrane.sources import draw

from . import kernels, quadtree


#: Points a chunk at most, where the number of chunks is not given.
CHUNK = 20_000
#: Keys that a chunk of sparse points has at most to be laid out as a matrix.
FEW_KEYS = 256


def chunk_count(n: int, layers: int = 2) -> int:
    """Chunks of at most some ``CHUNK`` points, four at the least."""
    return max(4, -(-n * layers // CHUNK))


def scheme(n: int, threads: int = 4, layers: int = 2) -> dict:
    """Points a chunk, epochs, and iterations an epoch."""
    z = n * layers / threads
    return {"z": z, "epochs": int(np.floor(4 * np.log(n))), "iters": int(np.ceil(4 * np.log(z)))}


def nn_size(n: int, ppx: int, threads: int = 4, layers: int = 2, xppx: float = 3.0) -> int:
    z = n * layers / threads
    return int(min(3 * ppx, z - 1)) if threads == layers else int(round(min(xppx * ppx * layers / threads, z - 1)))


def initial(ids: DataFrame, layers: int, seed: int = 0) -> DataFrame:
    """(id, layer, y1, y2) uniform on a disk of radius sqrt(1/2)/2."""
    d = ids.select("id", F.explode(F.sequence(F.lit(1), F.lit(layers))).alias("layer"))
    r = F.sqrt(draw(F.lit(f"{seed}r"), F.col("id").cast("string"), F.col("layer").cast("string"))) * np.sqrt(0.5) / 2
    a = 2 * np.pi * draw(F.lit(f"{seed}a"), F.col("id").cast("string"), F.col("layer").cast("string"))
    return d.select("id", "layer", (r * F.cos(a)).alias("y1"), (r * F.sin(a)).alias("y2"))


def chunk_assignment(ids: DataFrame, threads: int, layers: int, seed: int, epoch: int) -> DataFrame:
    """(worker, layer, id): points in ``threads`` chunks by a draw of the epoch; worker r lays out chunk r + l in layer l + 1.

    Chunks are cut by the draw itself, so they are even up to chance and no total order is needed.
    """
    chunk = F.floor(draw(F.lit(f"{seed}:{epoch}"), F.col("id").cast("string")) * threads).cast("int")
    d = ids.select("id", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(layers - 1))).alias("l"))
    return d.select(F.pmod(F.col("chunk") - F.col("l"), F.lit(threads)).cast("int").alias("worker"), (F.col("l") + 1).alias("layer"), "id")


def bounded(theta: float) -> float:
    """Opening angles under 0.33 mean no tree, and none is over 0.8."""
    return 0.0 if theta < 0.33 else min(theta, 0.8)


@dataclass
class Layout:
    y: DataFrame
    costs: list[tuple[int, int, float]] = field(default_factory=list)  # epoch, worker, cost
    sizes: list[tuple[int, float]] = field(default_factory=list)
    frames: list[DataFrame] = field(default_factory=list)
    state: DataFrame | None = None  # of a global layout: id, places, updates, gains


def _size(y: DataFrame) -> float:
    w, h = F.max("y1") - F.min("y1"), F.max("y2") - F.min("y2")
    return float(y.where("layer = 1").agg(F.sqrt(w * w + h * h)).first()[0])


def _epoch(points: DataFrame, betas: DataFrame, y: DataFrame, assigned: DataFrame, threads: int, size: int, iters: int, eta: float, alpha: float, theta: float) -> DataFrame:
    """(id, layer, y1, y2, worker, cost): every worker improves its own points; a (point, layer) has one worker.

    Each worker's points are a partition of their own: by a plain grouping several workers share a task, and run one after the other.
    """
    kind, schema = kind_of(points), "id bigint, layer int, y1 double, y2 double, worker int, cost double"
    rows = assigned.join(y, ["id", "layer"]).join(betas.select("id", "beta", "znorm"), "id")
    keys = F.array(*[F.lit(int(k)).cast("bigint") for k in partition_keys(points.sparkSession, threads)])

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("task", F.element_at(keys, F.col("worker") + 1)).repartition(threads, "task")

    def improve(f: pd.DataFrame, pick: np.ndarray, p: np.ndarray) -> pd.DataFrame:
        pos, c = kernels.run_chunk(f[["y1", "y2"]].to_numpy(), pick, p, iters, eta, alpha, theta)
        return pd.DataFrame({"id": f["id"], "layer": f["layer"], "y1": pos[:, 0], "y2": pos[:, 1], "worker": f["worker"], "cost": c})

    def of_points(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["layer", "id"], ignore_index=True)
        beta, znorm, most = f["beta"].to_numpy(), f["znorm"].to_numpy(), min(size, len(f) - 1)
        if kind == "dense":
            return improve(f, *kernels.affinities_of(np.stack(f["x"].to_numpy()), beta, znorm, most))
        sizes = f["x"].map(len).to_numpy()
        keys, values = (np.concatenate([list(get(m)) for m in f["x"]]) for get in (dict.keys, dict.values))
        used, place = np.unique(keys, return_inverse=True)
        if 0 < len(used) <= FEW_KEYS:
            x = np.zeros((len(f), len(used)))
            x[np.repeat(np.arange(len(f)), sizes), place] = values
            return improve(f, *kernels.affinities_of(x, beta, znorm, most))
        ends = np.concatenate(([0], np.cumsum(sizes)))

        def near(part: slice) -> np.ndarray:
            held = slice(ends[part.start], ends[min(part.stop, len(f))])
            return sparse_block((sizes[part], keys[held], values[held]), (sizes, keys, values))

        return improve(f, *kernels.affinities(near, beta, znorm, most))

    def of_partners(f: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["layer", "id"], ignore_index=True)
        if not len(f):
            return pd.DataFrame(columns=["id", "layer", "y1", "y2", "worker", "cost"])
        place = pd.Series(np.arange(len(f)), index=f["id"])
        i, j, rank = place[d["i"]].to_numpy(), place[d["j"]].to_numpy(), d["rank"].to_numpy() - 1
        # A point that lacks partners has itself instead, infinitely far away, which moves nothing.
        pick = np.repeat(np.arange(len(f))[:, None], min(size, len(f) - 1), axis=1)
        far = np.full(pick.shape, np.inf)
        pick[i, rank], far[i, rank] = j, d["sqdist"].to_numpy()
        return improve(f, pick, kernels.shares(pick, far, f["beta"].to_numpy(), f["znorm"].to_numpy()))

    if kind != "distances":
        return dealt(rows.join(points.select("id", "x"), "id")).groupBy("task").applyInPandas(of_points, schema)
    best = chunk_partners(points, betas, assigned, size)
    return dealt(rows).groupBy("task").cogroup(dealt(best).groupBy("task")).applyInPandas(of_partners, schema)


def chunk_partners(points: DataFrame, betas: DataFrame, assigned: DataFrame, size: int) -> DataFrame:
    """(worker, i, j, sqdist, rank): each point's ``size`` best partners among its worker's points, of a table of distances.

    Best by the sum of both ends' kernels; of equals the one of the lower layer, then of the lesser id. Pairs that the table
    lacks are no partners.
    """
    who = assigned.join(betas.select("id", "beta", "znorm"), "id")
    one, two = (who.select(F.col("worker").alias(w), F.col("id").alias(e), F.col("layer").alias(f"l{e}"), F.col("beta").alias(f"b{e}"), F.col("znorm").alias(f"z{e}")) for w, e in (("worker", "i"), ("w2", "j")))
    # A row a point and layer goes to each task, which is little beside the pairs.
    both = both_ways(points).where("i <> j").join(F.broadcast(one), "i").join(F.broadcast(two), "j").where("worker = w2")
    score = F.exp(-F.col("bi") * F.col("sqdist")) / F.col("zi") + F.exp(-F.col("bj") * F.col("sqdist")) / F.col("zj")
    some = foremost(both.select("worker", "i", "j", "lj", "sqdist", (-score).alias("value")), ["worker", "i"], ["lj"], size)
    met = some.repartition("worker", "i").groupBy("worker", "i", "j").agg(F.min("lj").alias("lj"), F.min("sqdist").alias("sqdist"), F.min("value").alias("value"))
    order = Window.partitionBy("worker", "i").orderBy("value", "lj", "j")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("worker", "i", "j", "sqdist", "rank")


def ptsne(points: DataFrame, betas: DataFrame, ppx: int, theta: float = 0.5, threads: int | None = None, layers: int = 2, seed: int = 0, y: DataFrame | None = None, epochs: int | None = None, iters: int | None = None, frames: bool = False, before: Layout | None = None) -> Layout:
    """Chunk-parallel t-SNE. ``threads`` is the number of chunks, without which a chunk has at most some ``CHUNK`` points.

    A chunk is a task: its memory grows with its points times their partners, its time with the square of its points. Partners
    get fewer as chunks do get more; where none would be left a greater perplexity or ``mtsne`` is asked for.
    """
    theta = bounded(theta)
    ids = ids_of(points)
    ids = checkpointed(ids) if kind_of(points) == "distances" else ids  # else all pairs are gone through wherever they are asked for
    n = ids.count()
    threads = threads or chunk_count(n, layers)
    layers = min(layers, threads)
    plan = scheme(n, threads, layers)
    total, per = plan["epochs"], iters if iters is not None else plan["iters"]
    size = nn_size(n, ppx, threads, layers)
    if size < 1 < n * layers / threads:
        raise ValueError(f"perplexity {ppx} leaves no partners in {threads} chunks: give a greater one, or lay out by mtsne")
    out = before or Layout(checkpointed(y if y is not None else initial(ids, layers, seed)))
    first = 0 if before is None else max((e for e, *_ in out.costs), default=0) + 1
    last = first + (epochs if epochs is not None else total)
    s, box = _size(out.y), [f(F.when(F.col("layer") == 1, F.col(c))).alias(f"{n_}{c}") for c in ("y1", "y2") for n_, f in (("low", F.min), ("high", F.max))]
    for e in range(first, last + (before is None)):
        eta = 2 * (s + 1 / s) * np.log(plan["z"] * size)
        alpha = kernels.MOMENTUM * max(0.0, 1 - max(e - 1, 0) / total) ** 2
        assigned = chunk_assignment(ids, threads, layers, seed, e)
        new = checkpointed(_epoch(points, betas, out.y, assigned, threads, size, 0 if e == 0 else per, eta, alpha, theta))
        out.y = new.select("id", "layer", "y1", "y2")
        told = new.groupBy("worker").agg(F.first("cost").alias("c"), F.count_if(F.col("layer") == 1).alias("n"), *box).collect()  # a row a worker
        costs = [(e, r["worker"], r["c"]) for r in told]
        out.costs += costs
        w, h = (np.max([r[f"high{c}"] for r in told if r["n"]]) - np.min([r[f"low{c}"] for r in told if r["n"]]) for c in ("y1", "y2"))
        s = float(np.sqrt(w * w + h * h))
        out.sizes.append((e, s))
        if frames:
            out.frames.append(out.y.withColumn("epoch", F.lit(e)))
        if np.mean([c for *_, c in costs]) < 0:
            break
    return out


def restart(points: DataFrame, betas: DataFrame, ppx: int, before: Layout, epochs: int, iters: int | None = None, **how) -> Layout:
    """Goes on from a layout; traces are continued."""
    return ptsne(points, betas, ppx, epochs=epochs, iters=iters, before=before, **how)


def global_affinities(points: DataFrame, betas: DataFrame, ppx: int, xppx: float = 3.0) -> DataFrame:
    """(i, j, p) of the neighbours within the bound of i: the kernels of both ends, not yet divided by their sum."""
    n = count_of(points)
    size = int(min(ppx * xppx, n - 1))
    near = within_bound(points, min(int(xppx * ppx + 1), n - 1), size)
    b = betas.select("id", "beta", "znorm")
    d = near.join(b.toDF("i", "bi", "zi"), "i").join(b.toDF("j", "bj", "zj"), "j")
    p = F.exp(-F.col("bi") * F.col("sqdist")) / F.col("zi") + F.exp(-F.col("bj") * F.col("sqdist")) / F.col("zj")
    return d.select("i", "j", p.alias("p"))


STATE = ("y1", "y2", "u1", "u2", "g1", "g2")


def mtsne(
    points: DataFrame, betas: DataFrame, ppx: int, iters: int = 250, theta: float = 0.5, seed: int = 0, y: DataFrame | None = None, frames: bool = False,
    stop: float = 2e-4, every: int = 25, until: int | None = None, before: Layout | None = None, log_size: bool = True, reset: bool = False, block: int | None = None,
) -> Layout:
    """Global t-SNE: places, updates and gains are a table; attraction is a join with the affinities, which stay where they are, repulsion is summed by blocks.

    The repulsion is exact, or by a quadtree over tables if ``theta`` is 0.33 or more; no task holds the whole layout, and
    only sums come to the driver. ``until`` ends after so many of the ``iters`` iterations, and ``before`` goes on from there:
    together they are one run. A start ``y`` of another method is refined likewise. If the cost rises by more than ``stop``
    the layout stays as it was; at a smaller rise, with ``reset``, gains go back to 1. ``log_size`` false takes the size of the
    data off the step length.
    """
    n, theta = count_of(points), bounded(theta)
    p = checkpointed(global_affinities(points, betas, ppx))
    total = p.agg(F.sum("p")).first()[0] or 0.0
    spark, groups = points.sparkSession, group_count(points, n, block)
    edges = tiles(p, groups) if n > 1 else None
    rate = np.log(float(n) * min(3 * ppx, n - 1)) if log_size and n > 1 else 1.0
    if before is None:
        start = (y if y is not None else initial(ids_of(points), 1, seed)).where("layer = 1")
        zero, one = F.lit(0.0), F.lit(1.0)
        state = checkpointed(start.select("id", "y1", "y2", zero.alias("u1"), zero.alias("u2"), one.alias("g1"), one.alias("g2")))
        out = Layout(None, state=state)
    else:
        out = Layout(None, list(before.costs), list(before.sizes), list(before.frames), before.state)
    bounds = [f(c).alias(n_) for c, a in (("y1", 1), ("y2", 2)) for f, n_ in ((F.min, f"low{a}"), (F.max, f"high{a}"))]
    box, done = out.state.agg(*bounds).first() if n else None, None
    for it in range(len(out.costs) + 1, (until if until is not None else iters) + 1):
        if n < 2:
            break
        low, high = (np.array([box[f"{w}{k}"] for k in (1, 2)]) for w in ("low", "high"))
        size = float(np.hypot(*(high - low)))
        push = repulsions(out.state, block or 2048) if theta < 0.33 else quadtree.repulsions(out.state, theta, low, high, n, block)
        met = out.state.join(push, "id").join(pulls(out.state, edges, groups), "id", "left").fillna(0.0, ["a1", "a2", "c"])
        with batches_of(spark, 16 << 20):
            met = written(met)
        whole = met.agg(F.sum("q").alias("z"), F.sum("c").alias("c")).first()
        c = float((np.log(whole["z"]) + (whole["c"] / total if total else 0.0)) / np.log(n * (n - 1.0)))
        last = out.costs[-1][2] if out.costs else np.inf
        out.costs.append((it - 1, 0, c))
        if c > last + stop:
            break
        out.sizes.append((it - 1, size))
        eta, alpha = 2 * (size + 1 / size) * rate, kernels.MOMENTUM * (1 - it / iters) ** 2
        new = {}
        for k in "12":
            slope = (F.col(f"a{k}") / total if total else F.lit(0.0)) - F.col(f"r{k}") / whole["z"]
            gain = F.lit(1.0) if reset and c > last else F.col(f"g{k}")
            gain = F.when((slope < 0) != (F.col(f"u{k}") < 0), gain + 0.1 * kernels.GAIN).otherwise(gain * (1 - 0.1 * kernels.GAIN))
            update = alpha * F.col(f"u{k}") - eta * gain * slope
            new |= {f"y{k}": F.col(f"y{k}") + update, f"u{k}": update, f"g{k}": gain}
        out.state = met.select("id", *[new[c].alias(c) for c in STATE])  # one step on rows that are written out
        box = out.state.agg(*bounds).first()
        if not out.frames:  # frames read the rounds that they are of
            dropped(done)
        done = met
        if frames and it % every == 0:
            out.frames.append(out.state.select("id", F.lit(1).alias("layer"), "y1", "y2", F.lit(it).alias("epoch")))
    out.y = out.state.select("id", F.lit(1).alias("layer"), "y1", "y2")
    return out


def layer_average(y: DataFrame) -> DataFrame:
    """(id, y1, y2): the mean place of each point over layers."""
    return y.groupBy("id").agg(F.avg("y1").alias("y1"), F.avg("y2").alias("y2"))


def mutual_affinities(points: DataFrame, betas: DataFrame, size: int, pivots: int | None = None, computed=None) -> DataFrame:
    """(i, j, p): each point's ``size`` best partners by the sum of both ends' kernels, and their affinities.

    The kernels of both ends, each divided by what its own end has picked in all; an end that picked nothing adds nothing.
    """
    b = betas.select("id", "beta", "znorm")
    picked = partners(points, b, size, pivots=pivots, computed=computed).join(b.toDF("i", "bi", "zi"), "i").join(b.toDF("j", "bj", "zj"), "j")
    k = checkpointed(picked.select("i", "j", kernel("bi", "zi").alias("own"), kernel("bj", "zj").alias("back")))
    total = k.groupBy("i").agg(F.sum("own").alias("t"))
    both = k.join(total, "i").join(total.toDF("j", "u"), "j")
    share = [F.coalesce(F.try_divide(a, b), F.lit(0.0)) for a, b in (("own", "t"), ("back", "u"))]
    return both.select("i", "j", (0.5 / max(count_of(points), 1) * (share[0] + share[1])).alias("p"))


def repulsions(y: DataFrame, block: int = 2048) -> DataFrame:
    """(id, r1, r2, q) of ``y(id, y1, y2)``: sums of q^2 (y_i - y_j) and of q over the others.

    A task holds a group of blocks and adds up what all others, which pass by once, do to it: a row a point comes back.
    """
    points = y.select("id", F.array("y1", "y2").alias("x"))
    blocks = max(1, -(-(n := points.count()) // block_size(points, n, block)))
    packed = block_matrices(points, blocks)

    def run(frames):
        group, held = None, []

        def given():
            for ids, _, push, mass in held:
                yield pd.DataFrame({"id": ids, "r1": push[:, 0], "r2": push[:, 1], "q": mass - 1.0})

        for f in frames:
            for r in f.itertuples(index=False):
                if r.g != group:
                    yield from given()
                    group, held = r.g, []
                p = np.asarray(r.flat, dtype=float).reshape(-1, 2)
                if not r.side:
                    held.append((np.asarray(r.ids), p, np.zeros_like(p), np.zeros(len(p))))
                    continue
                for _, own, push, mass in held:
                    one, q = kernels.pushed(own, p)
                    push += one
                    mass += q
        yield from given()

    return streamed(packed, packed, blocks, n).mapInPandas(run, "id bigint, r1 double, r2 double, q double")


def attractions(y: DataFrame, p: DataFrame) -> DataFrame:
    """(id, a1, a2, c) of layout ``y`` and affinities ``p(i, j, p)``: sums of p q (y_i - y_j) and of p ln(1 / q) over a point's partners."""
    one, two = (y.select(F.col("id").alias(i), F.col("y1").alias(a), F.col("y2").alias(b)) for i, a, b in (("i", "a1", "a2"), ("j", "b1", "b2")))
    d1, d2 = F.col("a1") - F.col("b1"), F.col("a2") - F.col("b2")
    sq = d1 * d1 + d2 * d2
    e = p.join(one, "i").join(two, "j")
    return e.groupBy(F.col("i").alias("id")).agg(F.sum(F.col("p") * d1 / (1 + sq)).alias("a1"), F.sum(F.col("p") * d2 / (1 + sq)).alias("a2"), F.sum(F.col("p") * F.log1p(sq)).alias("c"))


#: Points a group of ``tiles``, where there are too few for a group to each core.
FEW = 256


def group_count(points: DataFrame, n: int, few: int | None = None) -> int:
    """Groups of points for ``tiles``, which are as large as each other: one a core, until it would hold more than ``GROUP`` points."""
    return max(1, min(-(-n // (few or FEW)), max(points.sparkSession.sparkContext.defaultParallelism, -(-n // GROUP))))


def _grouped(id: str, groups: int):
    return F.pmod(F.xxhash64(id), F.lit(groups)).cast("int")


def tiles(p: DataFrame, groups: int) -> DataFrame:
    """(g, b, i, j, p): affinities ``p(i, j, p)`` as a row for each two groups of points, in a partition for each group of i's where later joins find them."""
    keys = F.array(*[F.lit(int(k)).cast("bigint") for k in partition_keys(p.sparkSession, groups)])
    dealt = p.where("p > 0").select(F.element_at(keys, _grouped("i", groups) + 1).alias("g"), _grouped("j", groups).alias("b"), "i", "j", "p")
    rows = dealt.repartition(groups, "g").groupBy("g", "b").agg(F.collect_list(F.struct("i", "j", "p")).alias("r"))
    return in_place(rows.select("g", "b", *[F.col(f"r.{c}").alias(c) for c in ("i", "j", "p")]))


def pulls(y: DataFrame, edges: DataFrame, groups: int) -> DataFrame:
    """(id, a1, a2, c) like ``attractions``, of ``tiles``: only places move, once for each group."""
    keys = F.array(*[F.lit(int(k)).cast("bigint") for k in partition_keys(y.sparkSession, groups)])
    rows = F.sort_array(F.collect_list(F.struct("id", "y1", "y2")))
    blocks = y.where("id is not null").groupBy(_grouped("id", groups).alias("b")).agg(rows.alias("r"))
    own = blocks.select(F.element_at(keys, F.col("b") + 1).alias("g"), F.col("r").alias("own")).repartition(groups, "g")
    sent = blocks.select(F.explode(keys).alias("g"), F.col("b").alias("b2"), F.col("r").alias("other")).repartition(groups, "g")

    def run(frames):
        held = {}
        for f in frames:
            for r in f.itertuples(index=False):
                one, two = ((np.asarray(ids), np.stack([y1, y2])) for ids, y1, y2 in ((r.id, r.y1, r.y2), (r.id2, r.z1, r.z2)))
                i, j, p = np.asarray(r.i), np.asarray(r.j), np.asarray(r.p)
                at, to = (np.minimum(np.searchsorted(ids, e), len(ids) - 1) for (ids, _), e in ((one, i), (two, j)))
                on = (one[0][at] == i) & (two[0][to] == j)  # others have no place
                at, to, p = at[on], to[on], p[on]
                d1, d2 = one[1][:, at] - two[1][:, to]
                sq = d1 * d1 + d2 * d2
                w = p / (1 + sq)
                ids, sums = held.setdefault(r.g, (one[0], np.zeros((3, len(one[0])))))
                for s, v in zip(sums, (w * d1, w * d2, p * np.log1p(sq))):
                    s += np.bincount(at, v, len(ids))
        for ids, sums in held.values():
            yield pd.DataFrame({"id": ids, "a1": sums[0], "a2": sums[1], "c": sums[2]})

    # The second condition is no key: partitions are by the group alone.
    met = edges.join(sent, (edges["g"] == sent["g"]) & (F.col("b") - F.col("b2") == 0)).drop(sent["g"]).join(own, "g")
    ends = [F.col(f"{side}.{c}").alias(n) for side, names in (("own", ("id", "y1", "y2")), ("other", ("id2", "z1", "z2"))) for c, n in zip(("id", "y1", "y2"), names)]
    return met.select("g", "i", "j", "p", *ends).mapInPandas(run, "id bigint, a1 double, a2 double, c double")


def forces(y: DataFrame, p: DataFrame) -> DataFrame:
    """(id, a1, a2, c, r1, r2, q): attraction and repulsion of every point, those without partners too."""
    none = {c: 0.0 for c in ("a1", "a2", "c")}
    return repulsions(y).join(attractions(y, p), "id", "left").fillna(none)


def gradient(y: DataFrame, p: DataFrame) -> DataFrame:
    """(id, dy1, dy2): the slope of the layout's cost, from an edge join and block sums."""
    f = checkpointed(forces(y, p))
    whole = f.agg(F.sum("q").alias("z")).crossJoin(p.agg(F.sum("p").alias("s")))  # one row
    part = [(over(F.col(f"a{k}"), F.col("s")) - over(F.col(f"r{k}"), F.col("z"))).alias(f"dy{k}") for k in (1, 2)]
    return f.join(F.broadcast(whole)).select("id", *part)


def cost(y: DataFrame, p: DataFrame) -> DataFrame:
    """(cost): the divergence of the layout, scaled by ln(n (n - 1)); null for fewer than two points."""
    f = forces(y, p).agg(F.sum("c").alias("c"), F.sum("q").alias("z"), F.count(F.lit(1)).alias("n"))
    near = f.crossJoin(p.agg(F.sum("p").alias("s")))  # one row
    n = F.col("n").cast("double")
    return near.select(F.try_divide(over(F.col("c"), F.col("s")) + F.log("z"), F.log(n * (n - 1))).alias("cost"))


def neighbour_check(points: DataFrame, betas: DataFrame, size: int, sample: int, seed: int = 0) -> DataFrame:
    """(id, positive, total): in a sample of points, how many picked affinities are positive, and their sum."""
    if sample < count_of(points):
        chosen = ids_of(points).orderBy(draw(F.lit(str(seed)), F.col("id").cast("string"))).limit(sample)
        ends = [chosen.withColumnRenamed("id", e) for e in ("i", "j")] if kind_of(points) == "distances" else []
        points = points.join(ends[0], "i").join(ends[1], "j") if ends else points.join(chosen, "id")
    points = checkpointed(points)
    p = mutual_affinities(points, betas, min(size, max(count_of(points) - 1, 1)))
    return p.groupBy(F.col("i").alias("id")).agg(F.count_if(F.col("p") > 0).alias("positive"), F.sum("p").alias("total"))
