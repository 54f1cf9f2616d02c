"""Per-trace fits meet the optimality conditions of the searches they stand for, in a number of steps that does not follow the samples one by one."""

import numpy as np

from glimmer.operators import numerics, spikes


def traces(count, n=64, seed=4):
    rng = np.random.default_rng(seed)
    return [np.convolve((rng.random(n) < 0.15) * rng.random(n), 0.8 ** np.arange(20))[:n] + rng.normal(0, 0.05, n) for _ in range(count)]


def test_constrained_ar1_needs_few_tries(monkeypatch):
    """F28 deconvolve_ar1: the penalty at the noise by the roots of pools, not by 30 halvings."""
    tries, pools = [], numerics.ar1_pools
    monkeypatch.setattr(numerics, "ar1_pools", lambda *a: tries.append(1) or pools(*a))
    for y in traces(20):
        y = y - y.min()
        limit = 0.05**2 * len(y)
        c, _, lam = numerics.constrained_ar1(y, 0.8, 0.05)
        rest = lambda lam: ((y - numerics.oasis_ar1(y, 0.8, lam)[0]) ** 2).sum()
        assert abs(((y - c) ** 2).sum() - limit) < 1e-8 * limit if rest(0.0) <= limit else lam == 0.0
    assert len(tries) < 20 * 15
    flat = np.full(10, 0.01)
    assert not numerics.constrained_ar1(flat, 0.8, 1.0)[0].any() and numerics.constrained_ar1(np.array([0.0, np.nan, 1.0]), 0.8, 0.1)[2] == 0.0


def test_convolution_fits_take_few_solves(monkeypatch):
    """F27 deconvolve_exp2, F30 deconvolve_ar2, F31 constrained_fit_optimal: supports change in blocks, and later fits start from earlier ones."""
    solves, solved = [], numerics._solved
    monkeypatch.setattr(numerics, "_solved", lambda *a: solves.append(1) or solved(*a))
    kernel = numerics.two_exponentials(0.8, 0.3, 40)
    for y in traces(20):
        y = y - y.min()
        c, s = numerics.convolution_nnls(y, kernel, 0.01)
        pull = np.correlate(np.append(y - 0.01 - c, np.zeros(39)), kernel, "valid")
        assert (s >= 0).all() and pull.max() < 1e-8 and np.abs(pull[s > 0]).max(initial=0.0) < 1e-8
        again = len(solves)
        assert np.allclose(numerics.convolution_nnls(y, kernel, 0.01, start=s)[1], s, atol=1e-12) and len(solves) == again + 1
    assert len(solves) < 20 * 15


def test_kernels_of_many_traces_are_those_of_each():
    """F1 kernel_refined: poles of many traces at once, traces of different lengths and without spikes among them."""
    ys = [*traces(40), *traces(3, 90), np.zeros(64), np.full(5, -1.0)]
    many = spikes.refitted_kernels(ys, 0.8, 0.3, 0.01, 40)
    for y, got in zip(ys, many, strict=True):
        one = spikes.refitted_kernel(y, 0.8, 0.3, 0.01, 40)
        assert abs(one["d"] - got["d"]) < 1e-9 and abs(one["r"] - got["r"]) < 1e-9 and one["settled"] == got["settled"]
        assert np.allclose(one["c"], got["c"]) and len(got["s"]) == len(y)
    y, at, t = ys[0], np.array([3, 20, 41]), np.arange(1, 41)
    x = np.stack([np.append(np.zeros(a), numerics.two_exponentials(0.7, 0.2, 40))[:64] if a + 40 >= 64 else np.concatenate([np.zeros(a), numerics.two_exponentials(0.7, 0.2, 40), np.zeros(24 - a)]) for a in at], axis=1)
    want = ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()
    assert np.isclose(spikes.energies_left(y[None], [at], 40)(0.7 ** t[None], 0.2 ** t[None])[0], want)


def test_constrained_fits_are_spread(spark):
    """F31 constrained_fit_optimal: a table of one part is fitted by more than one task."""
    from conftest import DATA

    from glimmer import registry

    for name in ("constrained_fit_optimal", "oasis_ar2_exact"):
        assert registry.queries()[name](spark, DATA).rdd.getNumPartitions() > 1
