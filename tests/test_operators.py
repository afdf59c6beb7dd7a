"""Operators on small made inputs, nulls, ties and plateaus included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane import sources
from terrane.embed import layout
from terrane.operators import calibration, covariates, landscape, neighbours, pairs


def test_sparse_equals_dense(spark):
    packed = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 3.0, 0.0]), (2, [1.0, 1.0, 7.0, 4.0]), (3, [0.0])], "id long, p array<double>")
    x = sources.sparse(packed, "id", "p")
    got = {(r["i"], r["j"]): r["sqdist"] for r in pairs.sparse_sqdist(x).collect()}
    assert got == {(1, 2): 26.0, (1, 3): 13.0, (2, 3): 17.0}


def test_distance_rows_are_squared(spark):
    d = spark.createDataFrame([(0, [0.0, 3.0]), (1, [3.0, 0.0])], "id long, d array<double>")
    assert {(r["i"], r["j"], r["sqdist"]) for r in sources.from_distance_rows(d, "id", "d").collect()} == {(0, 0, 0), (0, 1, 9), (1, 0, 9), (1, 1, 0)}


def test_nearest_in_blocks_is_exact(spark):
    x = np.random.default_rng(0).normal(size=(120, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = {(r["i"], r["rank"]): r["j"] for r in neighbours.nearest(df, 5, block=17).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for i, row in enumerate(np.argsort(d, axis=1)[:, :5]):
        assert [got[i, k + 1] for k in range(5)] == row.tolist()


def test_duplicates_are_found(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, [2.0])], "id long, x array<double>")
    assert [tuple(r) for r in sources.duplicated(df).collect()] == [(1, 2)]


def test_csv_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3,4.5\n")
    assert [r["x"] for r in sources.from_csv(spark, str(tmp_path / "a.csv")).orderBy("id").collect()] == [[1.0, 2.0], [3.0, 4.5]]
    assert sources.shape(sources.from_csv(spark, str(tmp_path / "a.csv"))) == (2, 2)


def test_quantile_levels(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 11)] + [(11, None)], "k int, v double")
    got = [r["level"] for r in covariates.quantile_levels(df, "k", "v", 4).orderBy("k").collect()]
    assert got == [1, 1, 1, 2, 2, 3, 3, 4, 4, 4, 5]
    few = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 9.0), (4, None)], "k int, v double")
    assert [r["level"] for r in covariates.quantile_levels(few, "k", "v", 8).orderBy("k").collect()] == [3, 5, 8, 9]


def test_neighbour_counts(spark):
    n8 = {r["cell"]: r["count"] for r in landscape.neighbours(landscape.cells(spark, 3), 3).groupBy("cell").count().collect()}
    n4 = {r["cell"]: r["count"] for r in landscape.neighbours(landscape.cells(spark, 3), 3, True).groupBy("cell").count().collect()}
    assert [n8[i] for i in range(9)] == [4, 6, 4, 6, 9, 6, 4, 6, 4] and [n4[i] for i in range(9)] == [3, 4, 3, 4, 5, 4, 3, 4, 3]


def test_density_of_one_point(spark):
    y = spark.createDataFrame([(1, 0.0, 0.0, 2.0)], "id long, y1 double, y2 double, beta double")
    assert landscape.density(y, 41).agg(F.sum("z")).first()[0] == pytest.approx(0.995834816294, abs=1e-9)


def test_level_plain_is_one_cluster(spark):
    z = [0, 0, 0, 0, 0, 0, 5, 5, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 3]
    r = spark.createDataFrame([(i, i % 5, i // 5, float(v)) for i, v in enumerate(z)], "cell long, cx int, cy int, z double")
    c = {x["cell"]: x["cluster"] for x in landscape.watershed(r, 5).collect()}
    assert c[6] == c[7] == 1 and c[24] == 2 and len(c) == 25


def test_mixture_is_recovered_end_to_end(spark):
    pts = sources.example(spark, 300, components=4, seed=3)
    b = calibration.calibrate(pts.select("id", "x"), 20).cache()
    out = layout.ptsne(pts.select("id", "x"), b, 20, threads=2, layers=2, epochs=6, seed=1)
    mean = {e: np.mean([c for e2, _, c in out.costs if e2 == e]) for e, *_ in out.costs}
    assert mean[max(mean)] < mean[0] and out.y.count() == 600
    y = layout.layer_average(out.y)
    assert y.count() == 300


def test_mapping_steps(spark):
    from terrane.mapping import Mapping

    pts = sources.example(spark, 200, components=3, seed=5)
    y = pts.select("id", F.lit(1).alias("layer"), (F.col("x")[0] * 3).alias("y1"), (F.col("x")[1] * 3).alias("y2"))
    m = Mapping.start(pts.select("id", "x"), 15, pts.select("id", "label")).place(y).density(15, g=30).cluster()
    n = m.clusters.select("cluster").distinct().count()
    assert m.point_labels().count() == 200 and n >= 3
    merged = m.merge(2)
    assert len(set(merged.merged.labels.values())) == len(merged.merged.labels) - len(merged.merged.steps)
    assert merged.point_labels(True).select("cluster").distinct().count() <= len(set(merged.merged.labels.values()))
    assert m.class_density(pts.select("id", "label")).agg(F.sum("p")).first()[0] == pytest.approx(m.raster.agg(F.sum("z")).first()[0])
    assert m.scatter().columns == ["id", "y1", "y2", "class"] and m.precision_map(4).count() == 200
    with pytest.raises(ValueError):
        Mapping.start(pts.select(F.lit(1).alias("id"), "x").unionByName(pts.select(F.lit(2).alias("id"), "x")), 15)
