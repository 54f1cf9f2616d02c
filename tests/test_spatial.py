"""Lasso paths against coordinate descent, and weights at the noise of each pixel."""

import numpy as np
import pytest

from glimmer.operators import spatial, updates


def lasso(gram, b, lam, non_negative, rounds=20_000):
    w = np.zeros(len(b))
    for _ in range(rounds):
        old = w.copy()
        for j in range(len(b)):
            z = w[j] * gram[j, j] + b[j] - gram[j] @ w
            w[j] = max(z - lam, 0) / gram[j, j] if non_negative else np.sign(z) * max(abs(z) - lam, 0) / gram[j, j]
        if np.abs(w - old).max() < 1e-13:
            break
    return w


@pytest.mark.parametrize("non_negative", [True, False])
@pytest.mark.parametrize("seed", range(6))
def test_path_is_the_lasso_at_its_knots(seed, non_negative):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(30, 8)) @ (np.eye(8) + 0.6 * rng.random((8, 8)))
    y = x @ np.where(rng.random(8) < 0.6, rng.normal(size=8), 0) + 0.3 * rng.normal(size=30)
    gram, b = x.T @ x, x.T @ y
    knots = spatial.lasso_path(gram, b, non_negative)
    assert all(a[0] >= c[0] for a, c in zip(knots, knots[1:])) and knots[-1][0] == 0
    for (a, v), (c, w) in zip(knots, knots[1:]):
        for share in (0.5, 1.0):
            assert np.allclose(v + share * (w - v), lasso(gram, b, a + share * (c - a), non_negative), atol=1e-6)
    residual = lambda w: ((y - x @ w) ** 2).sum()
    limit = (residual(knots[-1][1]) + (y**2).sum()) / 2
    w, lam, reached = spatial.lasso_at_noise(gram, b, float(y @ y), limit, non_negative)
    assert reached and residual(w) == pytest.approx(limit) and np.allclose(w, lasso(gram, b, lam, non_negative), atol=1e-6)
    assert not spatial.lasso_at_noise(gram, b, float(y @ y), 0.0, non_negative)[2]
    assert not spatial.lasso_at_noise(gram, b, float(y @ y), float(y @ y) + 1, non_negative)[0].any()


def test_weights_enter_and_leave():
    """With correlated columns a weight enters, leaves and comes back no more."""
    gram = np.array([[1.0, 0.9, 0.8], [0.9, 1.0, 0.95], [0.8, 0.95, 1.2]])
    b = np.array([0.95, 1.0, 1.02])
    for lam, w in spatial.lasso_path(gram, b):
        assert np.allclose(w, lasso(gram, b, lam, True), atol=1e-7)
    twice = np.ones((2, 2))
    assert spatial.lasso_path(twice, np.array([1.0, 1.0]))[-1][1].sum() == pytest.approx(1)
    assert spatial.lasso_path(np.eye(2), np.array([-1.0, -2.0])) [0][0] == 0
    assert len(spatial.lasso_path(np.zeros((0, 0)), np.zeros(0))) == 1


def test_weights_at_noise(spark):
    rng = np.random.default_rng(3)
    c = np.abs(rng.normal(size=(5, 80)))
    a = np.where(rng.random((600, 5)) < 0.3, rng.random((600, 5)), 0)
    y = a @ c + 0.05 * rng.normal(size=(600, 80))
    px = spark.createDataFrame([(i, [float(x) for x in y[i]], 0.05 if i else 1e-9) for i in range(600)], "px long, trace array<double>, noise double").repartition(3)
    pairs = spark.createDataFrame([(k, i) for i in range(600) for k in range(5) if i != 7] + [(9, 7)], "k long, px long")  # 9 has no trace
    traces = spark.createDataFrame([(k, [float(x) for x in c[k]]) for k in range(5)], "k long, c array<double>")
    got = {r.px: r for r in spatial.weights_at_noise(px, pairs, traces).collect()}
    assert got.keys() == set(range(600)) - {7} and not got[0].reached
    for i, r in got.items():
        w = np.array(r.w)
        left = ((y[i] - w @ c) ** 2).sum()
        assert list(r.k) == list(range(5)) and (w >= 0).all()
        assert not r.reached or not w.any() and (y[i] ** 2).sum() <= 0.05**2 * 80 or left == pytest.approx(0.05**2 * 80)
    assert sum(r.reached for r in got.values()) > 200
    back = spark.createDataFrame([(i, [float(x) for x in (a[i] @ c)]) for i in range(600)], "px long, trace array<double>")
    none = spatial.weights_at_noise(px.where("px = 20").withColumn("noise", px.noise * 0 + 1.0), pairs, traces, back).collect()
    assert not any(none[0].w)


def test_regressed_footprints_share_equal_traces(spark):
    px = spark.createDataFrame([(3, [2.0, 4.0])], "px long, trace array<double>")
    pairs = spark.createDataFrame([(1, 3), (2, 3)], "k long, px long")
    traces = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "k long, c array<double>")
    assert sorted((r.k, r.px, round(r.w, 9)) for r in updates.regressed_footprints(px, pairs, traces).collect()) == [(1, 3, 1.0), (2, 3, 1.0)]
