"""Pruned searches against all pairs, and forces and affinities from joins against the kernels on one array."""

import numpy as np
import pytest

from terrane.embed import kernels, layout
from terrane.operators import calibration, neighbours, pairs


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, x array<double>")


def sparse(spark, x):
    return spark.createDataFrame([(i, {k + 1: float(c) for k, c in enumerate(v) if c}) for i, v in enumerate(x)], "id long, x map<int,double>")


def clustered(n, seed=0, m=6, many=20):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(many, m)) * 10)[rng.integers(0, many, n)] + rng.normal(size=(n, m))


def brute(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, -1)
    return {(i, r + 1): j for i, row in enumerate(np.argsort(d, axis=1, kind="stable")[:, :k]) for r, j in enumerate(row)}


def found(df):
    return {(r["i"], r["rank"]): r["j"] for r in df.collect()}


@pytest.mark.parametrize("kind", [frame, sparse])
def test_pruned_search_is_that_of_all_pairs(spark, kind):
    x = np.round(clustered(900), 2)
    computed = spark.sparkContext.accumulator(0)
    assert found(neighbours.nearest(kind(spark, x), 7, pivots=30, computed=computed)) == brute(x, 7)
    assert computed.value < 0.15 * len(x) ** 2


def test_large_cells_are_cut_and_repeats_tie_by_id(spark):
    x = np.round(clustered(500, m=2), 0)
    x[100:270] = x[3]  # a third of all points at one place
    assert found(neighbours.nearest(frame(spark, x), 12, block=40, pivots=12)) == brute(x, 12)


def test_search_of_some_points(spark):
    x = clustered(400)
    some = frame(spark, x).where("id % 7 = 0")
    want = {key: j for key, j in brute(x, 5).items() if key[0] % 7 == 0}
    assert found(neighbours.nearest(frame(spark, x), 5, of=some, pivots=16)) == want


def test_more_neighbours_than_points(spark):
    x = clustered(9)
    assert found(neighbours.nearest(frame(spark, x), 20)) == brute(x, 20)


def test_one_pass_for_many_perplexities(spark, monkeypatch):
    points, passes = frame(spark, clustered(300, m=3)).cache(), []
    monkeypatch.setattr(calibration, "nearest", lambda *a, **k: passes.append(a[1]) or neighbours.nearest(*a, **k))
    together = {(r["id"], r["ppx"]): r[2:] for r in calibration.calibrate(points, [4, 9, 20]).collect()}
    assert passes == [62]
    for p in (4, 9, 20):
        for r in calibration.calibrate(points, p).collect():
            assert together[r["id"], p] == pytest.approx(r[2:], rel=1e-12)


@pytest.mark.parametrize("spread", [False, True])
def test_mutual_affinities(spark, spread):
    x = clustered(600, m=4)
    rng = np.random.default_rng(1)
    beta, znorm = (rng.uniform(0.01, 3, 600), rng.uniform(0.5, 4, 600)) if spread else (np.full(600, 0.3), np.full(600, 2.0))
    betas = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(beta, znorm))], "id long, beta double, znorm double")
    pick, p = kernels.affinities(pairs.sqdist(x, x), beta, znorm, 8)
    want = {(i, int(j)): v for i in range(600) for j, v in zip(pick[i], p[i])}
    computed = spark.sparkContext.accumulator(0)
    got = {(r["i"], r["j"]): r["p"] for r in layout.mutual_affinities(frame(spark, x), betas, 8, pivots=25, computed=computed).collect()}
    assert got.keys() == want.keys() and all(got[e] == pytest.approx(want[e], abs=1e-15) for e in want)
    assert computed.value < (0.9 if spread else 0.25) * 600**2
    given = pairs.pair_sqdist(frame(spark, x[:60]))
    pick, p = kernels.affinities(pairs.sqdist(x[:60], x[:60]), beta[:60], znorm[:60], 8)
    got = {(r["i"], r["j"]): r["p"] for r in layout.mutual_affinities(given, betas, 8).collect()}
    assert got == {(i, int(j)): pytest.approx(v, abs=1e-15) for i in range(60) for j, v in zip(pick[i], p[i])}


def test_forces_from_joins(spark):
    rng = np.random.default_rng(4)
    x, y = clustered(150, m=3), rng.normal(size=(150, 2)) * 3
    y[5] = y[6]
    pick, p = kernels.affinities(pairs.sqdist(x, x), np.full(150, 0.3), np.full(150, 2.0), 10)
    edges = spark.createDataFrame([(i, int(j), float(v)) for i in range(150) for j, v in zip(pick[i], p[i])], "i long, j long, p double")
    places = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(y)], "id long, y1 double, y2 double")
    got = np.array([r[1:] for r in layout.gradient(places, edges).orderBy("id").collect()])
    assert np.allclose(got, kernels.gradient(y, pick, p), atol=1e-12)
    assert layout.cost(places, edges).first()[0] == pytest.approx(kernels.cost(y, pick, p))
    push, mass = kernels.repulsion(y)
    got = np.array([r[1:] for r in layout.repulsions(places, block=32).orderBy("id").collect()])
    assert np.allclose(got[:, :2], push) and got[:, 2].sum() == pytest.approx(mass)


def test_no_group_of_all_points(spark):
    x = frame(spark, clustered(40, m=3))
    b = x.selectExpr("id", "2.0D beta", "3.0D znorm")
    plan = layout.mutual_affinities(x, b, 5)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "CartesianProduct" not in plan


def test_forces_of_no_and_one_point(spark):
    none, edges = spark.createDataFrame([], "id long, y1 double, y2 double"), spark.createDataFrame([], "i long, j long, p double")
    assert layout.gradient(none, edges).collect() == []
    assert [tuple(r) for r in layout.gradient(none.union(spark.createDataFrame([(1, 2.0, 3.0)], none.schema)), edges).collect()] == [(1, 0.0, 0.0)]
