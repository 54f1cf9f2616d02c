"""Pools of AR(2) traces against non-negative least squares, and refits of decay, kernel and baseline."""

import numpy as np
import pytest

from glimmer.operators import numerics, spikes


def ar2_trace(rng, n=3000, g=(1.7, -0.712), rate=0.5, noise=1.0, base=0.0):
    s = (rng.random(n) < rate / 30).astype(float)
    c = np.zeros(n)
    for t in range(n):
        c[t] = s[t] + (g[0] * c[t - 1] if t else 0) + (g[1] * c[t - 2] if t > 1 else 0)
    return c + base + noise * rng.normal(size=n), c, s


def dense_nnls(y, kernel):
    n = len(y)
    lag = np.arange(n)[:, None] - np.arange(n)[None]
    return numerics.nnls(np.where(lag >= 0, kernel[np.clip(lag, 0, n - 1)], 0.0), y)


@pytest.mark.parametrize("lam", [0.0, 2.5])
def test_exact_pools_are_the_optimum(lam):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 40, 150):
        y = ar2_trace(rng, n, noise=0.3)[0]
        c, s = spikes.oasis_ar2(y, 1.7, -0.712, lam)
        want = dense_nnls(spikes.penalised(y, (1.7, -0.712), lam), numerics.ar2_response(1.7, -0.712, n))
        assert np.allclose(s, want, atol=1e-5) and (s >= 0).all()


def test_penalty_is_on_the_sum_of_spikes():
    rng = np.random.default_rng(1)
    y, h = rng.normal(size=30), numerics.ar2_response(1.2, -0.3, 30)
    k = np.array([[h[i - j] if i >= j else 0 for j in range(30)] for i in range(30)])
    assert np.allclose(k.T @ spikes.penalised(y, (1.2, -0.3), 0.7), k.T @ y - 0.7)


def test_twenty_long_traces():
    """T = 3000: the objective is the optimum's, and pools alone come close to it."""
    rng = np.random.default_rng(3)
    h = numerics.ar2_response(1.7, -0.712, 3000)[:400]
    for _ in range(20):
        y, truth, _ = ar2_trace(rng)
        c, s = spikes.oasis_ar2(y, 1.7, -0.712)
        want, _ = numerics.convolution_nnls(y, h)
        assert ((y - c) ** 2).sum() == pytest.approx(((y - want) ** 2).sum(), rel=1e-6)
        pools, _ = spikes.oasis_ar2(y, 1.7, -0.712, exact=False)
        assert ((y - c) ** 2).sum() <= ((y - pools) ** 2).sum() * (1 + 1e-9) < ((y - c) ** 2).sum() * 1.1
        assert np.corrcoef(c, truth)[0, 1] > 0.8


def test_least_spike():
    y, _, truth = ar2_trace(np.random.default_rng(5), noise=0.4)
    c, s = spikes.oasis_ar2(y, 1.7, -0.712, smin=0.5)
    assert ((s == 0) | (s >= 0.5)).all() and abs((s > 0).sum() - truth.sum()) < 0.4 * truth.sum()
    assert spikes.oasis_ar2(np.zeros(0), 1.7, -0.712)[0].shape == (0,)


def test_decay_and_baseline_are_found():
    rng = np.random.default_rng(13)
    s = (rng.random(3000) < 0.02).astype(float)
    c = np.zeros(3000)
    for t in range(1, 3000):
        c[t] = 0.95 * c[t - 1] + s[t]
    y = c + 0.5 + 0.1 * rng.normal(size=3000)
    got = spikes.refined_ar1(y, 0.85, 0.5, base=None)
    assert got["g"] == pytest.approx(0.95, abs=0.015) and got["base"] == pytest.approx(0.5, abs=0.1)
    assert not spikes.refined_ar1(y, 0.6, 0.5, base=None, rounds=1)["settled"]
    fixed = spikes.refined_ar1(y, 0.95, 0.1, base=0.5, fit_g=False)
    assert np.allclose(fixed["c"], numerics.oasis_ar1(y - 0.5, 0.95, 0.1)[0]) and fixed["settled"]
    d = numerics.deconvolve(y, "ar1", "constrained", [0.95], 0.1, base=None)
    assert d["settled"] and d["base"] == pytest.approx(0.5, abs=0.1)


def test_kernel_is_found():
    rng = np.random.default_rng(2)
    s = (rng.random(1000) > 0.98).astype(float)
    d, r = np.exp(-1 / 10), np.exp(-1 / 1)
    k = numerics.two_exponentials(d, r, 100)
    y = np.convolve(s, k / k.max())[:1000] + 0.04 * rng.normal(size=1000)
    got = spikes.refitted_kernel(y, np.exp(-1 / 5), 0.2, 0.01)
    assert got["d"] == pytest.approx(d, abs=0.02) and np.corrcoef(got["c"], y)[0, 1] > 0.97
    assert not spikes.refitted_kernel(np.zeros(50), 0.9, 0.2)["settled"]


def test_thinned_kernel():
    k = np.exp(-np.arange(40) / 6.0)
    assert spikes.thinned_kernel(k, 1)[:40] == pytest.approx(k)
    assert spikes.thinned_kernel(k, 4).sum() * 4 == pytest.approx(k.sum(), rel=0.02)


def test_complex_poles_are_reported():
    y = np.sin(np.arange(400) / 2.0) + 1
    assert numerics.deconvolve(y, "ar2", "foopsi", noise=0.01)["oscillates"]
