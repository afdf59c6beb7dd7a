"""The spread quadtree against one array, and global t-SNE over tables against steps on one array."""

import numpy as np
import pytest

from terrane import sources
from terrane.embed import kernels, layout, quadtree
from terrane.operators import calibration


def places(spark, y):
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(y)], "id long, y1 double, y2 double")


def crowded(n=700, seed=0):
    rng = np.random.default_rng(seed)
    y = np.concatenate((rng.normal(size=(n // 2, 2)), rng.normal(size=(n - n // 2 - 21, 2)) * 0.01 + 3, [[40.0, -25.0]], np.full((20, 2), 1.25)))
    return rng.permutation(y)


@pytest.mark.parametrize("theta, most", [(0.33, 15), (0.8, 60), (0.5, 5000)])
def test_spread_tree_is_the_tree(spark, theta, most):
    y = crowded()
    push, mass = quadtree.Quadtree(y).on(y, np.arange(len(y)), theta)
    got = quadtree.repulsions(places(spark, y).repartition(3), theta, y.min(axis=0), y.max(axis=0), len(y), most).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(len(y)))
    assert np.allclose([(r["r1"], r["r2"]) for r in got], push, atol=1e-9) and np.allclose([r["q"] for r in got], mass, atol=1e-9)


def one_array(spark, pts, betas, ppx, iters, theta, seed):
    """The same iterations in numpy."""
    p = layout.global_affinities(pts, betas, ppx).toPandas()
    start = layout.initial(pts, 1, seed).orderBy("id").toPandas()
    ids, y = start["id"].to_numpy(), start[["y1", "y2"]].to_numpy()
    i, j, w = np.searchsorted(ids, p["i"]), np.searchsorted(ids, p["j"]), p["p"].to_numpy()
    u, g, n, costs = np.zeros_like(y), np.ones_like(y), len(y), []
    for it in range(1, iters + 1):
        push, mass = kernels.repulsion(y, theta)
        d = y[i] - y[j]
        sq = (d**2).sum(axis=1)
        pull = np.zeros_like(y)
        np.add.at(pull, i, (w / (1 + sq))[:, None] * d)
        costs.append((np.log(mass) + (w * np.log1p(sq)).sum() / w.sum()) / np.log(n * (n - 1.0)))
        s = float(np.hypot(*np.ptp(y, axis=0)))
        y, u, g = kernels.step(y, u, g, pull / w.sum() - push / mass, 2 * (s + 1 / s) * np.log(n * min(3.0 * ppx, n - 1)), kernels.MOMENTUM * (1 - it / iters) ** 2)
    return y, costs


@pytest.mark.parametrize("theta", [0.0, 0.5])
def test_tables_give_the_same_layout_in_one_go_or_two(spark, theta):
    pts = sources.example(spark, 160, components=3, seed=2).select("id", "x")
    betas = calibration.calibrate(pts, 10).cache()
    y, costs = one_array(spark, pts, betas, 10, 4, theta, 1)
    whole = layout.mtsne(pts, betas, 10, iters=4, theta=theta, seed=1, block=50)
    half = layout.mtsne(pts, betas, 10, iters=4, theta=theta, seed=1, until=2, block=50)
    both = layout.mtsne(pts, betas, 10, iters=4, theta=theta, before=half, block=50)
    assert len(half.costs) == 2 and [c for *_, c in whole.costs] == pytest.approx(costs, abs=1e-9)
    for run in (whole, both):
        got = np.array([r[2:4] for r in run.y.orderBy("id").collect()])
        assert np.allclose(got, y, atol=1e-6 * np.abs(y).max()) and [c for *_, c in run.costs] == pytest.approx(costs, abs=1e-9)


def test_a_rise_of_the_cost_ends_the_run(spark):
    pts = sources.example(spark, 60, components=3, seed=2).select("id", "x")
    betas = calibration.calibrate(pts, 10).cache()
    run = layout.mtsne(pts, betas, 10, iters=4, theta=0.0, seed=1, stop=-1.0)
    kept = layout.mtsne(pts, betas, 10, iters=4, theta=0.0, seed=1, until=1)
    assert len(run.costs) == 2 and {tuple(r) for r in run.y.collect()} == {tuple(r) for r in kept.y.collect()}
    free = layout.mtsne(pts, betas, 10, iters=2, theta=0.0, seed=1, log_size=False, reset=True)
    assert free.y.count() == 60 and np.isfinite(free.costs[-1][2])


def test_rounds_do_not_grow(spark):
    """What a round reads is a table: the plan of the third is as long as that of the first."""
    pts = sources.example(spark, 40, components=2, seed=2).select("id", "x")
    b = pts.selectExpr("id", "1.0D beta", "1.0D znorm").cache()
    plans = [len(layout.mtsne(pts, b, 5, iters=10, theta=0.0, until=u).state._jdf.queryExecution().optimizedPlan().toString()) for u in (1, 3)]
    assert abs(plans[0] - plans[1]) < 0.2 * plans[0]
    run = layout.mtsne(pts, b, 5, iters=3, theta=0.0, frames=True, every=2, stop=np.inf)
    assert [f.first()["epoch"] for f in run.frames] == [2] and all(f.count() == 40 for f in run.frames)


def test_layouts_of_no_and_one_point(spark):
    pts = spark.createDataFrame([(1, [1.0, 2.0])], "id long, x array<double>")
    b = pts.selectExpr("id", "1.0D beta", "1.0D znorm")
    assert layout.mtsne(pts, b, 5, iters=3).y.count() == 1 and layout.mtsne(pts.limit(0), b, 5, iters=3).y.count() == 0
