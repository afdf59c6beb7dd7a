"""What moves and what a task holds, as inputs grow."""

import numpy as np
import pytest

from terrane.embed import kernels, layout
from terrane.operators import neighbours, quality
from terrane.operators.pairs import sqdist

from test_neighbours import brute, found, frame


def test_search_gives_back_a_points_first_few(spark, monkeypatch):
    """Not so many for each block that it meets; also far from the origin, where single precision says little."""
    sizes, inner = [], neighbours._compared
    monkeypatch.setattr(neighbours, "_compared", lambda *a: sizes.append((df := inner(*a)).count()) or df)
    x = np.random.default_rng(2).normal(size=(260, 8)) + 1e5
    x[7] -= 1e5
    x[40:60] = x[3]
    assert found(neighbours.nearest(frame(spark, x), 5, block=26)) == brute(x, 5)
    assert sizes and max(sizes) <= 5 * len(x)


def test_correlation_from_moments(spark):
    """Of all pairs' distances, but without a row or a block for a pair; also with a feature that does not vary, and far points."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(150, 5)) * 3 + 40, rng.normal(size=(150, 2))
    x[:, 2], x[9], y[:, 0] = 7.3, x[9] * 20, y[:, 0] + x[:, 0]
    far = [((p[:, None] - p[None]) ** 2).sum(axis=2) for p in (x, y)]
    want = [np.corrcoef(a, b)[0, 1] for a, b in zip(*far)]
    r = quality.hl_correlation(frame(spark, x), frame(spark, y))
    assert [v["r"] for v in r.orderBy("id").collect()] == pytest.approx(want, abs=1e-10)
    assert "Join" not in r._jdf.queryExecution().optimizedPlan().toString()


def test_all_ranks_move_no_pairs(spark, monkeypatch):
    """What tasks give back is a row a size and task, and what they are given a block for each group."""
    seen, inner = [], quality.streamed
    monkeypatch.setattr(quality, "streamed", lambda *a: seen.append(inner(*a)) or seen[-1])
    x = np.random.default_rng(5).normal(size=(300, 6))
    curve = {r["k"]: r["q"] for r in quality.knp(frame(spark, x), frame(spark, x[:, :2])).collect()}
    groups = 2 * spark.sparkContext.defaultParallelism
    assert seen[0].where("side = 1").count() <= groups * seen[0].where("side = 0").count()
    near = [np.argsort(((p[:, None] - p[None]) ** 2).sum(axis=2), axis=1, kind="stable") for p in (x, x[:, :2])]
    for k in (2, 17, 200):
        if k in curve:
            assert curve[k] == pytest.approx(np.mean([len(set(a[:k]) & set(b[:k])) for a, b in zip(*near)]) / k)


def test_repulsion_gives_back_a_row_a_point(spark):
    """Not one for each block that a point meets, to be added up after another shuffle."""
    y = np.random.default_rng(6).normal(size=(120, 2)) * 4
    places = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(y)], "id long, y1 double, y2 double")
    r = layout.repulsions(places, block=16)
    assert "Aggregate [id" not in r._jdf.queryExecution().optimizedPlan().toString()
    got = np.array([v[1:] for v in r.orderBy("id").collect()])
    push, mass = kernels.repulsion(y)
    assert np.allclose(got[:, :2], push) and got[:, 2].sum() == pytest.approx(mass)


def test_attraction_moves_places_only(spark):
    """Affinities are dealt out once: in a round nothing but the layout moves, and it is not broadcast; as the edge join, also where ends have no place."""
    rng = np.random.default_rng(8)
    p = spark.createDataFrame([(i, int(j), float(v)) for i in range(200) for j, v in zip(rng.permutation(230)[:15], rng.random(15) - 0.1)], "i long, j long, p double").where("p > 0 and i <> 7")
    y = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.normal(size=(210, 2)) * 3)] + [(None, 0.0, 0.0)], "id long, y1 double, y2 double")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = []
        for groups in (1, 5):
            pull = layout.pulls(y, layout.tiles(p, groups), groups)
            got = {r["id"]: tuple(r)[1:] for r in pull.collect()}
            for r in layout.attractions(y, p).collect():
                assert got.pop(r["id"]) == pytest.approx(tuple(r)[1:], abs=1e-12)
            assert all(v == (0, 0, 0) for v in got.values())
            plan = pull._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
            at = next(n for n, line in enumerate(plan) if "Scan ExistingRDD[g" in line)  # its parents are on the lines before, less far in
            depth = len(plan[at])
            for line in reversed(plan[:at]):
                inner = len(line) - len(line.lstrip(" :+-"))
                if inner < depth:
                    depth = inner
                    moved += [groups] if "Exchange" in line else []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert 5 not in moved  # a single group has no keys to be dealt out by


def test_rounds_use_affinities_in_place(spark, monkeypatch):
    monkeypatch.setattr(layout, "attractions", None)
    pts = spark.createDataFrame([(i, [float(i % 7), float(i)]) for i in range(30)], "id long, x array<double>")
    assert layout.mtsne(pts, pts.selectExpr("id", "1.0D beta", "1.0D znorm"), 5, iters=1, theta=0.0).y.count() == 30


@pytest.mark.parametrize("kind", ["plain", "copies", "grid", "far", "one place", "not numbers"])
def test_ranks_from_products_are_those_of_differences(monkeypatch, kind):
    """Hardly any distance is computed by differences, and none is in another step for it."""
    monkeypatch.setattr(quality, "PART", 100)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(600, 6))
    if kind == "copies":
        x = np.repeat(x[:300], 2, axis=0)
    elif kind == "not numbers":
        x[rng.random(600) < 0.05, 2] = np.nan
    else:
        x = {"grid": np.round(x), "far": x + 1e5, "one place": x * 0}.get(kind, x)
    ids, sizes, asked = rng.permutation(600), np.array(quality.kset(600)), []
    for k, (d, err, exact) in enumerate(quality.Near(x).rows(x[:40])):
        rank = np.empty(600, np.int64)
        rank[np.lexsort((ids, sqdist(x[k : k + 1], x)[0]))] = np.arange(1, 601)
        got = quality.steps_of(d, err, lambda places: asked.append(len(ids[places])) or exact(places), ids, sizes)  # noqa: B023
        assert (got == np.searchsorted(sizes, rank)).all()
    assert kind != "plain" or not asked
    assert kind != "copies" or sum(asked) < 40 * 600 / 2
