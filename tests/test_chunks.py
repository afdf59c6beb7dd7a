"""Chunks of the chunk-parallel layout: slabs against whole matrices, memory, tables of distances, numbers of chunks."""

import os
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.embed import kernels, layout, quadtree
from terrane.operators import calibration, neighbours, pairs
from terrane.operators.pairs import sqdist
from terrane.plans import catalogue


def whole(sq, beta, znorm, size):
    """Partners and affinities from full matrices."""
    k = np.exp(-beta[:, None] * sq) / znorm[:, None]
    np.fill_diagonal(k, 0)
    score = k + k.T
    np.fill_diagonal(score, -1)
    pick = np.argsort(-score, axis=1, kind="stable")[:, :size]
    rows = np.arange(len(sq))[:, None]
    total = k[rows, pick].sum(axis=1)
    return pick, 0.5 / len(sq) * (k[rows, pick] / total[:, None] + k[pick, rows] / total[pick])


@pytest.mark.parametrize("entries", [1, 500, 2_000_000])
def test_slabs_give_what_whole_matrices_give(monkeypatch, entries):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (90, 3)).astype(float)  # many ties
    beta, znorm = rng.uniform(0.2, 0.6, 90).round(1), np.full(90, 3.0)
    monkeypatch.setattr(kernels, "ENTRIES", entries)
    pick, p = kernels.affinities(lambda part: sqdist(x[part], x), beta, znorm, 12)
    want = whole(sqdist(x, x), beta, znorm, 12)
    assert (pick == want[0]).all() and np.allclose(p, want[1], rtol=1e-12)
    y = rng.normal(size=(90, 2))
    push, mass = kernels.repulsion(y)
    d = y[:, None] - y[None]
    q = 1 / (1 + (d**2).sum(axis=2))
    assert np.allclose(push, ((q**2)[:, :, None] * d).sum(axis=1)) and mass == pytest.approx(q.sum() - 90)


def test_tree_goes_by_blocks(monkeypatch):
    y = np.random.default_rng(6).normal(size=(300, 2))
    push, mass = quadtree.Quadtree(y).repulsion(0.5)
    monkeypatch.setattr(quadtree, "BLOCK", 7)
    other, total = quadtree.Quadtree(y).repulsion(0.5)
    assert np.allclose(push, other, rtol=1e-12) and mass == pytest.approx(total, rel=1e-12)


def test_memory_does_not_grow_with_the_square():
    rng = np.random.default_rng(7)
    x, beta, znorm = rng.normal(size=(6000, 4)), np.full(6000, 0.5), np.full(6000, 3.0)
    tracemalloc.start()
    try:
        pick, p = kernels.affinities(lambda part: sqdist(x[part], x), beta, znorm, 20)
        kernels.run_chunk(rng.normal(size=(6000, 2)), pick, p, 1, 1.0, 0.5, 0.5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 6000 * 6000 * 8 / 2  # half a matrix of all pairs


def test_numbers_of_chunks():
    assert layout.chunk_count(0) == layout.chunk_count(500) == layout.chunk_count(40_000) == 4
    assert layout.chunk_count(40_001) == 5 and layout.chunk_count(10_000_000) == 1000
    for n in (500, 123_456, 10_000_000):
        assert n * 2 / layout.chunk_count(n) <= layout.CHUNK


@pytest.fixture(scope="module")
def points(spark):
    x = np.random.default_rng(8).normal(size=(60, 4))
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, x array<double>")


def test_partners_of_tables_of_distances(spark, points):
    """Of a table of pairs both ways, with selves, less all pairs of point 5 but one: the best by brute force."""
    full = pairs.pair_sqdist(points)
    both = full.unionByName(full.select(F.col("j").alias("i"), F.col("i").alias("j"), "sqdist")).unionByName(points.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("sqdist")))
    given = both.where("i <> 5 and j <> 5 or least(i, j) = 5 and greatest(i, j) = 9").cache()
    betas = calibration.calibrate(points, 5).cache()
    assigned = layout.chunk_assignment(points, 3, 2, 1, 1).cache()
    got = {}
    for r in layout.chunk_partners(given, betas, assigned, 4).collect():
        got.setdefault((r["worker"], r["i"]), []).append((r["rank"], r["j"]))
    d = {(r["i"], r["j"]): r["sqdist"] for r in given.collect()}
    b = {r["id"]: (r["beta"], r["znorm"]) for r in betas.collect()}
    members = {}
    for r in assigned.collect():
        members.setdefault(r["worker"], []).append((r["layer"], r["id"]))
    want = {}
    for w, own in members.items():
        for _, i in own:
            scored = sorted((-sum(np.exp(-b[e][0] * d[i, j]) / b[e][1] for e in (i, j)), layer, j) for layer, j in own if j != i and (i, j) in d)
            if scored:
                want[w, i] = [(k + 1, s[2]) for k, s in enumerate(scored[:4])]
    assert {k: sorted(v) for k, v in got.items()} == want
    y = layout.ptsne(given, betas, 5, threads=3, layers=2, epochs=1, iters=3, seed=1).y
    assert y.count() == 120 and y.where("isnan(y1) or isnan(y2)").count() == 0


def test_too_many_chunks_for_the_perplexity(points):
    betas = calibration.calibrate(points, 5)
    with pytest.raises(ValueError, match="perplexity 1 "):
        layout.ptsne(points, betas, 1, threads=30, layers=2, epochs=1, iters=1)


@pytest.mark.parametrize("wide", [1e-3, 5.0, 200.0, 1e9])
def test_best_partners_of_points_are_those_of_distances(wide):
    rng = np.random.default_rng(9)
    for x in (rng.normal(size=(300, 8)) + 50, rng.integers(0, 3, (200, 3)).astype(float)):
        beta, znorm = wide * rng.random(len(x)).round(2), 0.1 + rng.random(len(x))
        want = kernels.affinities(lambda part: sqdist(x[part], x), beta, znorm, 15)  # noqa: B023
        got = kernels.affinities_of(x, beta, znorm, 15)
        assert (got[0] == want[0]).all() and np.array_equal(got[1], want[1])


def test_mass_is_that_of_the_repulsion(monkeypatch):
    y = np.random.default_rng(10).normal(size=(500, 2))
    assert kernels.mass(y) == pytest.approx(kernels.repulsion(y)[1], rel=1e-12)
    monkeypatch.setattr(kernels, "NEAR", 3000)
    assert kernels.mass(y) == pytest.approx(kernels.repulsion(y)[1], rel=1e-12)


def test_each_chunk_is_a_task_of_its_own(spark, points):
    betas = calibration.calibrate(points, 5).cache()
    assigned = layout.chunk_assignment(points, 4, 2, 1, 1)
    out = layout._epoch(points, betas, layout.initial(points, 2, 1), assigned, 4, 5, 1, 1.0, 0.5, 0.5)
    where = [(r["p"], r["worker"]) for r in out.select(F.spark_partition_id().alias("p"), "worker").distinct().collect()]
    assert len(where) == len({p for p, _ in where}) == len({w for _, w in where}) == 4


@pytest.mark.parametrize("held", [3, 40, 4_000_000])
def test_foremost_leaves_in_all_that_may_be_first(spark, monkeypatch, held):
    """Whatever a task holds: the first three others of each point by brute force, of a table with pairs twice, in both orders and with selves."""
    rng = np.random.default_rng(11)
    rows = [(int(i), int(j), float(d)) for i, j, d in zip(rng.integers(0, 25, 900), rng.integers(0, 25, 900), rng.integers(0, 30, 900))]
    monkeypatch.setattr(neighbours, "HELD", held)
    given = spark.createDataFrame(rows, "i long, j long, sqdist double").repartition(3)
    best = {}
    for i, j, d in rows:
        for a, b in ((i, j), (j, i)):
            best.setdefault(a, {a: -1.0})
            if a != b:
                best[a][b] = min(d, best[a].get(b, np.inf))
    want = {i: [j for j, _ in sorted(own.items(), key=lambda t: (t[1], t[0]))][:4] for i, own in best.items()}
    got = {}
    for r in neighbours.nearest(given, 4).orderBy("rank").collect():
        got.setdefault(r["i"], []).append(r["j"])
    assert got == want


def test_tasks_leave_in_little_of_a_table_of_distances(spark, points):
    """Of a table of all pairs each task leaves in three partners a point; before, all pairs were shuffled, in either order."""
    d = pairs.pair_sqdist(points)
    plan = neighbours.foremost(pairs.both_ways(d).withColumn("value", F.col("sqdist")), ["i"], [], 3)
    assert plan.groupBy(F.col("i")).count().where("count > 3 * 8").count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["ptsne_distance_map", "ptsne_map", "ptsne_sparse_map"])
def test_layouts_take_all_rounds_of_the_scheme(spark, monkeypatch, name):
    """A start and every epoch, each of all iterations; before, two or four epochs."""
    rounds = []

    def unmoved(points, betas, y, assigned, threads, size, iters, *rest):
        rounds.append(iters)
        return y.join(assigned, ["id", "layer"]).select("id", "layer", "y1", "y2", "worker", F.lit(1.0).alias("cost"))

    monkeypatch.setattr(layout, "_epoch", unmoved)
    n = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() // 2
    plan = layout.scheme(n)
    assert rounds == [0] + [plan["iters"]] * plan["epochs"]
