"""Invariants of the numerics, and recovery of synthetic traces."""

import itertools

import numpy as np
import pytest

from glimmer.operators import numerics as n
from glimmer.operators.graphs import hungarian
from glimmer.operators.patches import axis_spans


def trace(seed=13, g=0.95, noise=0.3, frames=600, rate=0.5 / 30):
    rng = np.random.default_rng(seed)
    s = (rng.random(frames) < rate).astype(float)
    c = np.zeros(frames)
    for t in range(frames):
        c[t] = (g * c[t - 1] if t else 0) + s[t]
    return c + noise * rng.standard_normal(frames), c, s


def test_oasis_is_feasible_and_optimal():
    y, _, _ = trace(frames=120)
    c, s = n.oasis_ar1(y, 0.9)
    assert (s >= 0).all() and np.allclose(s[1:], c[1:] - 0.9 * c[:-1])
    best, _ = n.convolution_nnls(y, 0.9 ** np.arange(120))
    assert np.abs(c - best).max() < 1e-4


def test_oasis_recovers_spikes():
    y, c, s = trace(noise=0.1)
    found, spikes, _ = n.constrained_ar1(y, 0.95, 0.1)
    assert np.corrcoef(found, c)[0, 1] > 0.95
    assert ((y - found) ** 2).sum() <= 0.1**2 * len(y) * 1.001
    _, least, m = n.thresholded_ar1(y, 0.95, 0.1)
    assert ((least < 1e-9) | (least >= m - 1e-9)).all()


def test_noise_level():
    y = np.random.default_rng(1).standard_normal(2000) * 0.3
    for how in ("mean", "median", "logmexp"):
        assert 0.2 < n.noise_level(y, how=how) < 0.4
    assert n.noise_level(y) == pytest.approx(0.3, rel=0.1)


def test_nnls_conditions():
    rng = np.random.default_rng(2)
    a, y = rng.random((30, 6)), rng.standard_normal(30)
    x = n.nnls(a, y)
    gradient = a.T @ (y - a @ x)
    assert (x >= 0).all() and (gradient <= 1e-6).all() and np.abs(gradient[x > 0]).max(initial=0) < 1e-6


def test_hals_never_gets_worse():
    rng = np.random.default_rng(3)
    y = rng.random((20, 4)) @ rng.random((4, 40))
    a, c = rng.random((20, 4)), rng.random((4, 40))
    errors = []
    for _ in range(5):
        a, c = n.hals(y, a, c, 1)
        errors.append(((y - a @ c) ** 2).sum())
    assert all(x >= z - 1e-9 for x, z in itertools.pairwise(errors))


@pytest.mark.parametrize("seed", range(20))
def test_hungarian(seed):
    rng = np.random.default_rng(seed)
    cost = rng.random((4, 5))
    cost[rng.random((4, 5)) < 0.3] = np.inf
    pairs = hungarian(cost)
    best = (0, 0.0)
    for p in itertools.permutations(range(5), 4):
        own = [cost[i, j] for i, j in enumerate(p) if np.isfinite(cost[i, j])]
        best = max(best, (len(own), -sum(own)))
    assert len(pairs) == best[0] and sum(cost[i, j] for i, j in pairs) == pytest.approx(-best[1])


@pytest.mark.parametrize(("length", "size", "overlap", "least"), [(20, 8, 2, 3), (25, 8, 2, 3), (128, 32, 4, 8), (5, 8, 2, 3), (21, 8, 2, 4)])
def test_patches_cover(length, size, overlap, least):
    spans = axis_spans(length, size, overlap, least)
    assert set().union(*(range(a, b + 1) for a, b in spans)) == set(range(length))
    assert len(spans) == 1 or all(b - a + 1 >= least for a, b in spans)


def test_half_sample_mode():
    y = np.concatenate([np.random.default_rng(5).standard_normal(300) * 0.1 + 1, [10, 11, 12]])
    assert abs(n.half_sample_mode(y) - 1) < 0.1


def test_splines():
    x = np.linspace(0, 1, 64)
    basis = n.spline_basis(64, 6)
    assert np.allclose(basis.sum(axis=1), 1) and (basis >= 0).all() and basis.shape == (64, 9)
    assert np.allclose(n.spline_detrended(3 * x**3 - x + 2, 6), 0, atol=1e-9)
    y = np.random.default_rng(4).standard_normal(64)
    once = n.spline_detrended(y, 6)
    assert np.allclose(n.spline_detrended(once, 6), once)


def test_ar2_spikes():
    h = n.ar2_response(1.2, -0.4, 80)
    s = np.zeros(80)
    s[[5, 30, 33]] = [1.0, 2.0, 0.5]
    y = np.convolve(s, h)[:80]
    assert np.allclose(h[2:], 1.2 * h[1:-1] - 0.4 * h[:-2])
    assert np.allclose(n.convolution_nnls(y, h)[1], s, atol=1e-6)
    c, found = n.thresholded_spikes(y + 0.01 * np.random.default_rng(6).standard_normal(80), h, 0.3)
    assert np.allclose(found, s, atol=0.1) and ((found == 0) | (found >= 0.3)).all() and np.allclose(c, np.convolve(found, h)[:80])


def test_nnls_has_no_limit_of_spikes():
    """More than 200 spikes come out, and the optimality conditions hold."""
    rng = np.random.default_rng(4)
    s = np.where(rng.random(600) < 0.5, 1 + rng.random(600), 0.0)
    h = 0.5 ** np.arange(40)
    y = np.convolve(s, h)[:600]
    c, found = n.convolution_nnls(y, h)
    assert (s > 0).sum() > 200 and np.allclose(found, s, atol=1e-6) and np.allclose(c, y, atol=1e-6)
    noisy = y + 0.2 * rng.standard_normal(600)
    c, found = n.convolution_nnls(noisy, h)
    w = np.correlate(noisy - c, h, "full")[len(h) - 1 :][:600]
    assert (found > 0).sum() > 200 and w.max() < 1e-6 and np.abs(w[found > 0]).max() < 1e-6


def test_thresholded_spikes_end_with_a_fit():
    """Every round drops a few spikes; what is left is the fit of its own frames."""
    rng = np.random.default_rng(7)
    h = 0.9 ** np.arange(60)
    y = np.convolve(np.where(rng.random(300) < 0.3, rng.random(300), 0.0), h)[:300] + 0.3 * rng.standard_normal(300)
    c, s = n.thresholded_spikes(y, h, 0.5)
    assert (s[s > 0] >= 0.5).all()
    w = np.correlate(y - c, h, "full")[len(h) - 1 :][:300]
    assert np.abs(w[s > 0]).max() < 1e-6
