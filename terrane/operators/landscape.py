"""The density landscape: raster, class densities, cell grid, watershed clusters and their borders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.session import checkpointed

from .components import components


def raster_frame(y: DataFrame, g: int, g_exp: float = 3.0) -> dict:
    """Bounds of the raster: the extreme points, each moved out by ``g_exp`` of its own kernel deviations."""
    reach = F.when(F.col("beta") > 0, g_exp / F.sqrt(2 * F.col("beta"))).otherwise(F.lit(0.0))
    d = y.select("y1", "y2", reach.alias("r"))
    r = d.agg(
        F.min_by(F.col("y1") - F.col("r"), "y1").alias("x0"), F.max_by(F.col("y1") + F.col("r"), "y1").alias("x1"),
        F.min_by(F.col("y2") - F.col("r"), "y2").alias("y0"), F.max_by(F.col("y2") + F.col("r"), "y2").alias("y1"), F.count(F.lit(1)).alias("n"),
    ).first().asDict()
    if not r["n"]:
        return r | {"g": g, "d": None}
    return r | {"g": g, "d": (r["x1"] - r["x0"]) / (g - 1) * (r["y1"] - r["y0"]) / (g - 1)}


def density(y: DataFrame, g: int = 200, g_exp: float = 3.0, classes: str | None = None, frame: dict | None = None) -> DataFrame:
    """(cell, cx, cy, gx, gy, z) of ``y(id, y1, y2, beta)``; with ``classes``, a row for each (cell, class) and its p.

    Every task adds up a raster of its own, of each class it meets; rasters are then summed by cell. The kernel is a product of one in
    each direction, so a batch takes two short exponentials a point and one matrix product. No points give no cells.
    """
    fr = frame or raster_frame(y, g, g_exp)
    if not fr["n"]:
        kind = dict(y.dtypes)[classes] if classes else ""
        return y.sparkSession.createDataFrame([], f"cell bigint, class {kind}, p double" if classes else "cell bigint, cx int, cy int, gx double, gy double, z double")
    xs, ys = np.linspace(fr["x0"], fr["x1"], g), np.linspace(fr["y0"], fr["y1"], g)
    scale = fr["d"] / (np.pi * fr["n"])
    cell = np.arange(g * g)

    def partial(f: pd.DataFrame) -> np.ndarray:
        a, b, k = (f[c].to_numpy()[:, None] for c in ("y1", "y2", "beta"))
        return ((np.exp(-k * (b - ys) ** 2) * k).T @ np.exp(-k * (a - xs) ** 2)).ravel() * scale

    def run(frames):
        total = None
        for f in frames:
            part = partial(f)
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"cell": cell, "z": total})

    def run_classes(frames):
        total: dict = {}
        for f in frames:
            for c, own in f.groupby("class"):
                total[c] = total.get(c, 0.0) + partial(own)
        for c, z in total.items():
            yield pd.DataFrame({"cell": cell, "class": c, "z": z})

    cx, cy = F.pmod("cell", F.lit(g)).cast("int"), F.expr(f"cell div {g}").cast("int")
    gx, gy = F.lit(fr["x0"]) + cx * F.lit(xs[1] - xs[0]), F.lit(fr["y0"]) + cy * F.lit(ys[1] - ys[0])
    if classes:
        kind = dict(y.dtypes)[classes]
        parts = y.select("y1", "y2", "beta", F.col(classes).alias("class")).mapInPandas(run_classes, f"cell bigint, class {kind}, z double")
        return parts.groupBy("cell", "class").agg(F.sum("z").alias("p"))
    parts = y.select("y1", "y2", "beta").mapInPandas(run, "cell bigint, z double")
    return parts.groupBy("cell").agg(F.sum("z").alias("z")).select("cell", cx.alias("cx"), cy.alias("cy"), gx.alias("gx"), gy.alias("gy"), "z")


def class_conditional(p: DataFrame) -> DataFrame:
    """Each class's densities divided by their sum."""
    return p.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("class")))


def hard_map(p: DataFrame, levels: int = 16) -> DataFrame:
    """(cell, class): the class of highest density where the cell is above the lowest of ``levels`` and classes differ, else null."""
    rows = p.groupBy("cell").agg(F.sum("p").alias("s"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.max_by("class", F.struct("p", F.col("class"))).alias("best"))
    ends = rows.agg(F.min("s").alias("a"), F.max("s").alias("b"))
    least = F.col("a") + (F.col("b") - F.col("a")) / levels
    return rows.join(F.broadcast(ends)).select("cell", F.when((F.col("s") > least) & (F.col("lo") < F.col("hi")), F.col("best")).alias("class"))


def fuzzy_map(p: DataFrame) -> DataFrame:
    """(cell, class, p) with 0 where all classes of a cell are equal."""
    w = Window.partitionBy("cell")
    return p.withColumn("p", F.when(F.min("p").over(w) == F.max("p").over(w), F.lit(0.0)).otherwise(F.col("p")))


def grid_frame(y: DataFrame, g: int) -> DataFrame:
    """One row an axis: size, min, max, range, factor and the diagonal of a cell."""
    b = y.agg(*[f(c).alias(f"{n}{c}") for c in ("y1", "y2") for n, f in (("lo", F.min), ("hi", F.max))])
    axes = None
    for axis, c in (("x", "y1"), ("y", "y2")):
        row = b.select(F.lit(axis).alias("axis"), F.lit(g).alias("size"), F.floor(f"lo{c}").cast("double").alias("min"), F.ceil(f"hi{c}").cast("double").alias("max"))
        axes = row if axes is None else axes.unionByName(row)
    axes = axes.withColumn("range", F.col("max") - F.col("min")).withColumn("factor", F.try_divide(F.col("size").cast("double"), F.col("range")))
    one = Window.partitionBy()  # two rows
    return axes.withColumn("diag", F.sqrt(F.sum(F.pow(F.col("range") / F.col("size"), F.lit(2.0))).over(one)))


def point_cells(y: DataFrame, g: int, frame: str = "grid", raster: dict | None = None) -> DataFrame:
    """(id, cx, cy, cell). ``grid``: the frame of whole numbers around the points; ``raster``: the density's own bounds.

    Along an axis on which the frame has no extent all points are in cell 0.
    """
    if frame == "raster":
        fr = raster or raster_frame(y, g)
        lo1, hi1, lo2, hi2 = (F.lit(fr[k]).cast("double") for k in ("x0", "x1", "y0", "y1"))
    else:
        b = y.agg(F.floor(F.min("y1")).alias("a"), F.ceil(F.max("y1")).alias("b"), F.floor(F.min("y2")).alias("c"), F.ceil(F.max("y2")).alias("d")).first()
        lo1, hi1, lo2, hi2 = (F.lit(None if v is None else float(v)).cast("double") for v in b)
    top = F.lit(g - 1)
    scale = [F.coalesce(F.try_divide(F.lit(float(g)), hi - lo), F.lit(0.0)) for lo, hi in ((lo1, hi1), (lo2, hi2))]
    cx, cy = F.floor((F.col("y1") - lo1) * scale[0]), F.floor((F.col("y2") - lo2) * scale[1])
    d = y.select("id", F.least(cx, top).cast("int").alias("cx"), F.least(cy, top).cast("int").alias("cy"))
    return d.withColumn("cell", (F.col("cx") + F.col("cy") * g).cast("bigint"))


def cells(spark, g: int) -> DataFrame:
    return spark.range(g * g).select(F.col("id").alias("cell"), F.pmod("id", F.lit(g)).cast("int").alias("cx"), F.expr(f"id div {g}").cast("int").alias("cy"))


def neighbours(grid: DataFrame, g: int, cross: bool = False) -> DataFrame:
    """(cell, nb): the eight neighbours and the cell itself, or with ``cross`` the four; clipped at the borders."""
    steps = [(a, b) for b in (-1, 0, 1) for a in (-1, 0, 1) if not cross or a == 0 or b == 0]
    near = F.explode(F.array(*[F.struct((F.col("cx") + a).alias("x"), (F.col("cy") + b).alias("y")) for a, b in steps])).alias("s")
    inside = F.col("s.x").between(0, g - 1) & F.col("s.y").between(0, g - 1)
    return grid.select("cell", "cx", "cy", near).where(inside).select("cell", (F.col("s.x") + F.col("s.y") * g).cast("bigint").alias("nb"))


def peaks(raster: DataFrame, g: int) -> DataFrame:
    """(cell, z) of the cells that none of their neighbours exceeds.

    The raster is computed once: sums of another order have other last digits, and a peak would be held against its own.
    """
    raster = checkpointed(raster)
    z = raster.select(F.col("cell").alias("nb"), F.col("z").alias("nz"))
    top = neighbours(raster, g).join(z, "nb").groupBy("cell").agg(F.max("nz").alias("top"))
    return raster.join(top, "cell").where("z >= top").select("cell", "z")


def watershed(raster: DataFrame, g: int) -> DataFrame:
    """(cell, cluster, peak): cells follow the steepest ascent to a peak; clusters are numbered by falling peak density.

    The highest of a cell's neighbours is its parent (of equals the last in cell order). Connected cells of equal density
    are a plain: what does not touch anything higher on it goes to the cell of the plain that touches the highest, and if
    none does, to the plain's last cell, which is then one peak for all. Pointer jumping doubles the way of each round.
    """
    z = raster.select(F.col("cell").alias("nb"), F.col("z").alias("nz"))
    around = neighbours(raster, g).join(z, "nb").join(raster.select("cell", "z"), "cell")
    up = checkpointed(around.groupBy("cell", "z").agg(F.max(F.struct("nz", "nb")).alias("m")))
    level = checkpointed(around.where("z = nz AND cell <> nb").select(F.col("cell").alias("a"), F.col("nb").alias("b")))
    if level.isEmpty():
        at = up.select("cell", F.col("m.nb").alias("peak"))
    else:
        plain = components(level).select(F.col("node").alias("cell"), "root")
        held = up.join(plain, "cell", "left")
        exits = held.where("root IS NOT NULL").groupBy("root").agg(F.max("cell").alias("last"), F.max(F.when(F.col("m.nz") > F.col("z"), F.struct("m.nz", "cell"))).alias("exit"))
        to = F.when((F.col("m.nz") > F.col("z")) | F.col("root").isNull(), F.col("m.nb")).otherwise(F.coalesce("exit.cell", "last"))
        at = held.join(exits, "root", "left").select("cell", to.alias("peak"))
    at, moved = checkpointed(at), True
    while moved:
        step = at.select(F.col("cell").alias("c2"), F.col("peak").alias("p2"))
        new = checkpointed(at.join(step, F.col("peak") == F.col("c2")).select("cell", "peak", F.col("p2").alias("next")))
        moved = not new.where("peak <> next").isEmpty()
        at = new.select("cell", F.col("next").alias("peak"))
    top = at.select(F.col("peak").alias("cell")).distinct().join(raster.select("cell", "z"), "cell")
    order = Window.orderBy(F.desc("z"), "cell")  # one row a cluster
    ids = top.select(F.col("cell").alias("peak"), F.row_number().over(order).alias("cluster"))
    return at.join(ids, "peak").select("cell", "cluster", "peak")


def point_clusters(y: DataFrame, clusters: DataFrame | None, g: int, **frame) -> DataFrame:
    """(id, cluster); without clusters every point is in cluster 1."""
    if clusters is None:
        return y.select("id", F.lit(1).alias("cluster"))
    return point_cells(y, g, **frame).join(clusters, "cell").select("id", "cluster")


def borders(clusters: DataFrame, g: int) -> DataFrame:
    """(cell, nb, cluster, other): each pair of cells side by side in different clusters, once."""
    grid = clusters.select("cell", "cluster", F.pmod("cell", F.lit(g)).cast("int").alias("cx"), F.expr(f"cell div {g}").cast("int").alias("cy"))
    other = clusters.select(F.col("cell").alias("nb"), F.col("cluster").alias("other"))
    return neighbours(grid, g, cross=True).where("nb > cell").join(clusters, "cell").join(other, "nb").where("cluster <> other").select("cell", "nb", "cluster", "other")


def peak_table(clusters: DataFrame, raster: DataFrame) -> DataFrame:
    """(cluster, peak_cell, cx, cy, z)."""
    p = clusters.select("cluster", F.col("peak").alias("cell")).distinct()
    return p.join(raster, "cell").select("cluster", F.col("cell").alias("peak_cell"), "cx", "cy", "z")


def embedding_size(y: DataFrame) -> DataFrame:
    """The diagonal of the layout's bounding box."""
    w, h = F.max("y1") - F.min("y1"), F.max("y2") - F.min("y2")
    return y.agg(F.sqrt(w * w + h * h).alias("size"))
