"""Tables without rows, constant data, nulls, and the three kinds of points through calibration and embedding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane import sources
from terrane.embed import layout
from terrane.embed.quadtree import Quadtree
from terrane.embed import kernels
from terrane.operators import calibration, covariates, landscape, merging, neighbours, pairs, preprocess, quality


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, x array<double>")


@pytest.fixture(scope="module")
def kinds(spark):
    """The same points dense, sparse and as distances."""
    x = np.random.default_rng(3).normal(size=(70, 6)).round(2)
    x[:, 3:][np.random.default_rng(4).random((70, 3)) < 0.7] = 0
    dense = frame(spark, x)
    entries = F.filter(F.transform("x", lambda v, i: F.struct((i + 1).alias("k"), v.alias("v"))), lambda s: s["v"] != 0)
    sparse = dense.select("id", F.map_from_entries(entries).alias("x"))
    distances = pairs.pair_sqdist(dense)
    return dense, sparse, distances


def test_kinds_calibrate_alike(kinds):
    got = [{r["id"]: (r["beta"], r["lq"]) for r in calibration.calibrate(k, 8).collect()} for k in kinds]
    for other in got[1:]:
        assert other.keys() == got[0].keys()
        assert all(np.allclose(other[i], got[0][i], rtol=1e-6) for i in other)


def test_kinds_have_the_same_affinities_and_layouts(kinds):
    betas = calibration.calibrate(kinds[0], 8).cache()
    p = [{(r["i"], r["j"]): r["p"] for r in layout.global_affinities(k, betas, 8).collect()} for k in kinds]
    assert all(x.keys() == p[0].keys() and np.allclose([x[k] for k in p[0]], list(p[0].values())) for x in p[1:])
    y = [layout.ptsne(k, betas, 8, threads=2, layers=1, epochs=1, iters=2, seed=1).y.orderBy("id").select("y1", "y2").collect() for k in kinds]
    for other in y[1:]:
        assert np.allclose(np.array(other), np.array(y[0]), atol=1e-6)


def test_normalised(kinds):
    dense, sparse, distances = (pairs.normalised(k) for k in kinds)
    x = np.array([r["x"] for r in dense.orderBy("id").collect()])
    assert np.abs(x.mean(axis=0)).max() < 1e-9 and np.abs(x).max() == pytest.approx(1)
    assert distances.agg(F.max("sqdist")).first()[0] == 1 and sparse.agg(F.max(F.array_max(F.transform(F.map_values("x"), F.abs)))).first()[0] == 1


def test_tree_is_near_the_exact_repulsion():
    y = np.random.default_rng(1).normal(size=(600, 2))
    y[10] = y[11]
    push, mass = kernels.repulsion(y)
    some = np.array([3, 10, 11, 500])
    near, _ = Quadtree(y).repulsion(0.4, some)
    whole, total = Quadtree(y).repulsion(0.4)
    assert np.allclose(near, whole[some]) and abs(total - mass) / mass < 0.02
    assert np.linalg.norm(whole - push) / np.linalg.norm(push) < 0.05


def test_global_layout_by_tree(spark):
    pts = sources.example(spark, 150, components=3, seed=2).select("id", "x")
    betas = calibration.calibrate(pts, 10).cache()
    one, two = (layout.mtsne(pts, betas, 10, iters=6, theta=t, seed=1, frames=True, every=3) for t in (0.0, 0.5))
    assert len(two.frames) == 2 and two.frames[0].count() == 150
    assert abs(one.costs[-1][2] - two.costs[-1][2]) < 0.05


def test_no_cartesian_product(kinds):
    plan = neighbours.nearest(kinds[0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_no_rows(spark):
    points, y = frame(spark, []), spark.createDataFrame([], "id long, y1 double, y2 double, beta double, c int")
    assert landscape.density(y, 5).count() == 0 and landscape.density(y, 5, classes="c").count() == 0
    assert landscape.point_cells(y, 5).count() == 0 and landscape.point_cells(y, 5, frame="raster").count() == 0
    assert preprocess.whiten(points, 2).count() == 0 and preprocess.whiten(points, 4).count() == 0
    assert quality.hl_correlation(points, points).count() == 0 and quality.knp(points, points).count() == 0
    assert neighbours.nearest(points, 3).count() == 0 and pairs.pair_sqdist(points).count() == 0 and pairs.center_scale(points).count() == 0


def test_data_that_do_not_vary(spark):
    y = spark.createDataFrame([(i, 2.0, float(i), 0.5) for i in range(4)], "id long, y1 double, y2 double, beta double")
    assert {r["cx"] for r in landscape.point_cells(y, 5).collect()} == {0} and landscape.grid_frame(y, 5).where("factor is null").count() == 1
    same = frame(spark, [(1, 1)] * 9)
    assert [r["r"] for r in quality.hl_correlation(same, same).collect()] == [None] * 9
    assert {r["v"] for r in pairs.center_scale(same).collect()} == {0.0}
    assert {r["d"] for r in pairs.scale_distances(spark.createDataFrame([(1, 2, 0.0)], "i long, j long, d double")).collect()} == {0.0}


def test_points_without_a_place_are_named(spark):
    bad = spark.createDataFrame([(1, [1.0]), (7, None)], "id long, x array<double>")
    with pytest.raises(Exception, match="point without a place: id 7"):
        neighbours.nearest(bad, 2).collect()


def test_quantiles_of_many_ranges(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(0, 300, 2000).astype(float)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "k long, v double").repartition(7)
    got = {r["k"]: r["level"] for r in covariates.quantile_levels(df, "k", "v", 8).collect()}
    cuts = np.quantile(v, np.arange(1, 8) / 8)
    assert got == {i: 1 + int((cuts < x).sum()) for i, x in enumerate(v)}


def test_sampled_preservation(spark):
    x = np.random.default_rng(5).normal(size=(60, 3))
    whole = quality.knp(frame(spark, x), frame(spark, x)).collect()
    some = quality.knp(frame(spark, x), frame(spark, x), sampling=0.5).collect()
    assert all(r["q"] == 1 for r in whole) and all(r["q"] == 1 for r in some)


def test_results_are_saved_and_read(spark, tmp_path):
    sources.save({"a": spark.range(3)}, str(tmp_path))
    assert sources.load(spark, str(tmp_path), ["a"])["a"].count() == 3


def test_level_averages_and_traces(spark):
    pts = sources.example(spark, 60, components=2, seed=1).select("id", "x")
    betas = calibration.calibrate(pts, 8).cache()
    one = layout.ptsne(pts, betas, 8, threads=2, layers=2, epochs=1, iters=2, seed=1)
    two = layout.restart(pts, betas, 8, one, 1, iters=2, threads=2, layers=2)
    assert max(e for e, *_ in two.costs) == 2 and layout.layer_average(two.y).count() == 60
    assert layout.neighbour_check(pts, betas, 10, 60).where("positive > 10").count() == 0


def test_clusters_without_points_merge_too(spark):
    m = spark.createDataFrame([(c, d, n, float(c * d), 1.0) for c, n in ((1, 9), (2, 7), (4, 5)) for d in (0, 1)], "cluster int, dim int, n long, mean double, var double")
    father = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 3)], "cluster int, father int")
    edges = spark.createDataFrame([(a, b, 0.5, 0.5, 5.0 - a) for a, b in ((2, 1), (1, 2), (3, 1), (1, 3), (4, 3), (3, 4))], "cluster int, other int, z double, nz double, top double")
    out = merging.merge(m, father, edges, 2)
    assert out.complete and set(out.labels) == {1, 2, 3, 4} and len(set(out.labels.values())) == 2 and all(np.isfinite(s[3]) for s in out.steps)
