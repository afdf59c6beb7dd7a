"""Plains, components, hinges of large groups, ranks by groups, positions in files, the mixture."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane import sources
from terrane.operators import covariates, landscape, quality
from terrane.operators.components import components


def raster(spark, z):
    g = len(z)
    return spark.createDataFrame([(x + y * g, x, y, float(z[y][x])) for y in range(g) for x in range(g)], "cell long, cx int, cy int, z double")


def spiral(g):
    """A way of width one that winds inwards with a gap between its turns."""
    z = np.zeros((g, g))
    x, y, dx, dy = 0, 0, 1, 0
    z[0, 0] = 1
    while True:
        def free(a, b):
            ahead = (a + dx, b + dy)
            return 0 <= a < g and 0 <= b < g and z[b, a] == 0 and not (0 <= ahead[0] < g and 0 <= ahead[1] < g and z[ahead[1], ahead[0]])
        if not free(x + dx, y + dy):
            dx, dy = -dy, dx
            if not free(x + dx, y + dy):
                return z
        x, y = x + dx, y + dy
        z[y, x] = 1


def test_a_spiral_plain_is_one_cluster(spark):
    z = spiral(31)
    assert z.sum() > 400
    rows = landscape.watershed(raster(spark, z * 5 - np.arange(31 * 31).reshape(31, 31) * 1e-6 * (z == 0)), 31).collect()
    on = {r["cluster"] for r in rows if z[r["cell"] // 31, r["cell"] % 31]}
    assert on == {1} and {r["cluster"] for r in rows} == {1}  # the gaps lead up to it
    assert {r["peak"] for r in rows} == {max(c for c in range(31 * 31) if z[c // 31, c % 31])}


def test_a_plain_below_a_hill_drains_to_it(spark):
    z = np.zeros((7, 7))
    z[0, 0], z[0, 1], z[6, 6] = 9, 5, 4
    c = {r["cell"]: r["peak"] for r in landscape.watershed(raster(spark, z), 7).collect()}
    assert set(c.values()) == {0, 48} and c[1] == 0 and c[48] == 48
    assert c[41] == 48 and c[3] == 0 and c[24] == 0  # beside the lower hill; and by the plain's highest neighbour


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(400)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def hinges(v):
    v = np.sort(np.asarray(v, float))
    n = len(v)
    h = (n + 3) // 2 / 2
    q = [(v[int(np.floor(d)) - 1] + v[int(np.ceil(d)) - 1]) / 2 for d in (h, (n + 1) / 2, n + 1 - h)]
    inside = v[(v >= q[0] - 1.5 * (q[2] - q[0])) & (v <= q[2] + 1.5 * (q[2] - q[0]))]
    return (inside[0], *q, inside[-1])


def test_hinges_of_groups_of_any_size(spark):
    rng = np.random.default_rng(0)
    groups = {"one": [3.0], "two": [1.0, 2.0], "five": [1, 2, 3, 4, 100], "same": [7.0] * 9, "big": np.round(rng.normal(size=3000), 1), "six": rng.normal(size=6)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("big", None), ("none", None), ("six", float("nan")), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r["k"]: tuple(r[1:]) for r in covariates.box_stats(df, "k", "v").collect()}
    assert got.keys() == groups.keys() and all(got[k] == pytest.approx(hinges(v)) for k, v in groups.items())
    assert "Percentile" not in covariates.box_stats(df, "k", "v")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sampling", [1.0, 0.4])
def test_all_ranks_and_listed_ranks_agree(spark, sampling):
    rng = np.random.default_rng(3)
    x, y = np.round(rng.normal(size=(90, 3)) * 4), np.round(rng.normal(size=(90, 2)) * 4)  # exact, with ties
    fx, fy = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, x array<double>") for m in (x, y))
    sizes = quality.kset(90)
    got = {r["k"]: r["q"] for r in quality.knp(fx, fy, sampling=sampling).collect()}
    listed = {r["k"]: r["q"] for r in quality.knp(fx, fy, k_max=89, sampling=sampling).collect()}
    assert list(sorted(got)) == sizes and got == pytest.approx(listed)
    if sampling == 1:
        order = [np.argsort(((m[:, None] - m[None]) ** 2).sum(axis=2), axis=1, kind="stable") for m in (x, y)]
        assert got == {k: pytest.approx(np.mean([len({*order[0][i, :k]} & {*order[1][i, :k]}) / k for i in range(90)])) for k in sizes}
    sparse = fx.select("id", F.map_from_entries(F.transform("x", lambda v, i: F.struct(i + 1, v))).alias("x"))
    assert {r["k"]: r["q"] for r in quality.knp(sparse, fy, sampling=sampling).collect()}.keys() == got.keys()


def test_positions_run_over_files(spark, tmp_path):
    for name, rows in (("b.csv", range(10, 17)), ("a.csv", range(10)), ("c.csv", [])):
        (tmp_path / name).write_text("u,v\n" + "".join(f"{i},{i * i}.5\n" for i in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "24")  # several pieces a file
    try:
        got = {r["id"]: r["x"] for r in sources.from_csv(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i + 1: [float(i), i * i + 0.5] for i in range(17)}


def test_mixture_is_a_function_of_ids(spark):
    whole = {r["id"]: r for r in sources.example(spark, 4000, dims=3, components=5, seed=9).collect()}
    some = sources.example(spark, dims=3, components=5, seed=9, ids=spark.createDataFrame([(17,), (3999,)], "id long")).collect()
    assert all(whole[r["id"]] == r for r in some) and len(whole) == 4000
    for c in range(5):
        x = np.array([r["x"] for r in whole.values() if r["label"] == c])
        assert len(x) > 600 and (x.std(axis=0) > 0.4).all() and (x.std(axis=0) < 2.2).all() and np.ptp(x.std(axis=0)) < 0.3


def test_a_peak_is_held_against_the_same_sums(spark):
    """Rasters that differ in their last digits whenever they are computed, as sums of fetched parts do."""
    z = np.zeros((15, 15))
    z[1::3, 1::3] = np.arange(25).reshape(5, 5) + 1
    z += np.arange(225).reshape(15, 15) * 1e-6

    def run(frames):
        rng = np.random.default_rng()
        for f in frames:
            f["z"] *= 1 + rng.uniform(-1e-13, 1e-13, len(f))
            yield f

    made = raster(spark, z).mapInPandas(run, "cell long, cx int, cy int, z double")
    want = {x + 15 * y for x in range(1, 15, 3) for y in range(1, 15, 3)}
    assert {r["cell"] for r in landscape.peaks(made, 15).collect()} == want
