"""Numeric kernels against hand-computed values and direct formulas."""

import numpy as np
import pytest

from terrane.embed import kernels
from terrane.embed.layout import nn_size, scheme
from terrane.embed.quadtree import Quadtree
from terrane.functions.lambertw import lambert_wm1
from terrane.operators.calibration import TOLERANCE, partition_and_entropy, solve
from terrane.operators.merging import pooled, ratio
from terrane.operators.quality import kset


def test_lambert():
    w = lambert_wm1(np.array([-0.01, -0.1, -0.2, -0.3, -0.4, 0.1]))
    assert np.allclose(w[:4], [-6.472775124394, -3.577152063957, -2.542641357774, -1.781337023422], atol=1e-11)
    assert np.isnan(w[4:]).all()


def test_calibration_reaches_target_or_falls_back():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(16, 4))[rng.integers(0, 16, 400)] * 4 + rng.normal(size=(400, 4))
    d = np.sort(((x[:, None] - x[None]) ** 2).sum(axis=2), axis=1)
    beta, z = solve(d[:, :91] / 50, d[:, 91] / 50, 30)
    _, h = partition_and_entropy(d[:, :91] / 50, beta)
    assert (np.abs(h - np.log(30)) < TOLERANCE).mean() > 0.9
    assert (beta > 0).all() and (z > 0).all()


def test_same_points_do_not_break_calibration():
    beta, z = solve(np.zeros((1, 4)), np.zeros(1), 3)
    assert np.isfinite(beta).all() and np.isfinite(z).all()


def test_scheme_and_sizes():
    assert scheme(500) == {"z": 250.0, "epochs": 24, "iters": 23}
    assert nn_size(500, 30) == 45 and nn_size(500, 30, 2, 2) == 90
    assert kset(20)[-1] == 16 and len(kset(500)) == 77 and kset(500)[-1] == 496


def test_pooled_and_ratio():
    n, m, v = np.array([3.0, 2, 2]), np.array([[1.0], [4.5], [11]]), np.array([[1.0], [0.5], [2]])
    assert ratio(n, m, v) == pytest.approx(13.184948979592)
    for compat, var, value in ((False, 3.74, 9.641463633912), (True, -2.14, -32.761041730125)):
        t, mean, pv = pooled(n[:2], m[:2], v[:2], compat)
        assert (t, mean[0]) == (5, pytest.approx(2.4)) and pv[0] == pytest.approx(var)
        # The second cluster is the child: it is empty, its mean stays behind.
        nn, mm, vv = np.array([5.0, 0, 2]), np.array([mean, [4.5], [11]]), np.array([pv, [0.0], [2]])
        assert ratio(nn, mm, vv, compat) == pytest.approx(value)


def test_gradient_is_slope_of_cost_and_tree_agrees():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 5)), rng.normal(size=(60, 2))
    sq = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    pick, p = kernels.affinities(sq, np.full(60, 0.5), np.full(60, 2.0), 15)
    assert p.shape == (60, 15) and (p > 0).all()
    exact, mass = kernels.repulsion(y)
    near, total = Quadtree(y).repulsion(0.0)
    assert np.allclose(exact, near) and mass == pytest.approx(total)
    rough, total = Quadtree(y).repulsion(0.5)
    assert abs(total - mass) < 0.05 * mass and np.abs(rough - exact).max() < 0.1 * np.abs(exact).max()


def test_run_lowers_cost():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(4, 6)) * 8, 20, axis=0) + rng.normal(size=(80, 6))
    sq = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    pick, p = kernels.affinities(sq, np.full(80, 0.1), np.full(80, 2.0), 15)
    y = rng.normal(size=(80, 2)) * 0.3
    before = kernels.cost(y, pick, p)
    _, after = kernels.run_chunk(y, pick, p, 60, 5.0, 0.5, 0.0)
    assert after < before
