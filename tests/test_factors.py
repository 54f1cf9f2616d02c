"""Low-rank models against dense NumPy runs and planted backgrounds."""

import numpy as np
import pytest

from glimmer.operators import factors


def movie(spark, y, columns):
    rows = [(i, i // columns, i % columns, [float(v) for v in x]) for i, x in enumerate(y)]
    return spark.createDataFrame(rows, "px long, r int, c int, trace array<double>").repartition(3)


def table(d, size):
    out = np.zeros((size, len(d[0][1]) if d else 0))
    for k, x in d:
        out[k] = x
    return out


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(6)
    w, h = rng.gamma(1.0, 1.0, (40, 3)), np.abs(rng.normal(size=(3, 30)))
    return w, h, w @ h + 0.01 * rng.random((40, 30))


def test_error_never_rises(spark, planted):
    *_, y = planted
    start = dense_start(y, 3)
    w, h, errors = factors.nonnegative_factors(movie(spark, y, 8), 3, rounds=8, tol=0.0, start=start)
    want = []
    for _ in range(8):
        start = factors.descended(start.T, (factors.weights(y, start, True)).T.dot(y).T, (lambda x: x.T @ x)(factors.weights(y, start, True))).T
        want.append(start)
    assert np.allclose(h, want[-1], rtol=1e-6, atol=1e-9)
    assert all(b <= a * (1 + 1e-9) for a, b in zip(errors, errors[1:]))
    assert errors[-1] == pytest.approx(((y - factors.weights(y, want[-2], True) @ h) ** 2).sum(), rel=1e-6)
    w = table([(r.px, r.w) for r in w.collect()], 40)
    assert (w >= 0).all() and (h >= 0).all() and ((y - w @ h) ** 2).sum() < 0.02 * (y**2).sum()


def dense(y, h, rounds):
    for _ in range(rounds):
        w = np.maximum(y @ h.T @ np.linalg.inv(h @ h.T), 0)
        h = np.maximum(np.linalg.inv(w.T @ w) @ (w.T @ y), 0)
    return w, h


def dense_start(y, count):
    u, s, vt = np.linalg.svd(y, full_matrices=False)
    h = np.zeros((count, y.shape[1]))
    for j in range(count):
        a, b = u[:, j], vt[j]
        best = max(((np.linalg.norm(np.maximum(z * a, 0)) * np.linalg.norm(np.maximum(z * b, 0)), np.maximum(z * b, 0)) for z in (1, -1)), key=lambda t: t[0])
        h[j] = np.sqrt(s[j] * best[0]) * best[1] / np.linalg.norm(best[1])
    return np.where(h == 0, y.mean(), h)


def test_factors_equal_a_dense_run(spark, planted):
    *_, y = planted
    w, h, _ = factors.nonnegative_factors(movie(spark, y, 8), 3, rounds=5, method="als", start=dense_start(y, 3))
    _, want = dense(y, dense_start(y, 3), 5)
    assert np.allclose(h, want, rtol=1e-6, atol=1e-8)
    assert np.allclose(factors.start_factors(movie(spark, y, 8), 3), dense_start(y, 3), rtol=2e-2, atol=2e-2)


def test_product_is_never_formed(spark):
    rng = np.random.default_rng(2)
    a, b = np.where(rng.random((30, 6)) < 0.4, rng.random((30, 6)), 0), np.abs(rng.normal(size=(6, 25)))
    a[:, 0] += 0.1  # every pixel has a row
    foot = spark.createDataFrame([(k, px, float(a[px, k])) for k in range(6) for px in range(30) if a[px, k]], "k long, px long, w double")
    traces = spark.createDataFrame([(k, [float(x) for x in b[k]]) for k in range(6)] + [(99, [1.0] * 25)], "k long, c array<double>")
    w, h = factors.product_factors(foot, traces, 2, rounds=4, start=dense_start(a @ b, 2))
    want_w, want_h = dense(a @ b, dense_start(a @ b, 2), 4)
    assert np.allclose(h, want_h) and np.allclose(table([(r.px, r.w) for r in w.collect()], 30), want_w)
    _, own = factors.product_factors(foot, traces, 1, rounds=0)  # the start itself
    assert np.allclose(own, dense_start(a @ b, 1), rtol=1e-3)


def test_background_models(spark):
    rng = np.random.default_rng(4)
    rows, columns, frames = 12, 10, 1200
    t = np.arange(frames)
    image = np.add.outer(np.linspace(1, 2, rows), np.linspace(0, 1, columns)).ravel()
    slow = np.outer(image, 3 + np.sin(t / 400)) + np.outer(image[::-1], np.cos(t / 500) + 2)
    fast = np.outer(np.outer(np.hanning(rows + 2)[1:-1], np.ones(columns)).ravel(), np.sin(t / 3.0))
    for model, rank, y in (("nmf", 2, slow), ("svd", 2, slow), ("low_pass", 1, slow + fast)):
        noisy = y + 0.02 * rng.normal(size=y.shape)
        w, f = factors.background_model(movie(spark, noisy, columns), model, rank, rate=1.0, size=6)
        got = table([(r.px, r.trace) for r in factors.background_movie(w, f).collect()], rows * columns)
        inner = [i for i in range(rows * columns) if 0 < i // columns < rows - 1 and 0 < i % columns < columns - 1]
        assert np.sqrt(((got - y)[inner] ** 2).mean()) < (0.04 if model != "low_pass" else 0.12), model
    with pytest.raises(ValueError):
        factors.background_model(movie(spark, slow[:, :5], columns), "other")


def test_medians_over_tiles(spark):
    rng = np.random.default_rng(9)
    image = rng.random((40, 35))
    d = spark.createDataFrame([(i * 35 + j, i, j, [float(image[i, j])]) for i in range(40) for j in range(35)], "px long, r int, c int, w array<double>")
    padded = np.pad(image, 2)
    want = {i * 35 + j: np.median(padded[i : i + 5, j : j + 5]) for i in range(40) for j in range(35)}
    got = {r.px: r.w[0] for r in factors.median_images(d, 2).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_splines_sum_to_one():
    x = factors.splines(50, 6)
    assert x.shape[0] == 50 and np.allclose(x.sum(axis=1), 1) and np.linalg.matrix_rank(x) == x.shape[1]


def test_empty(spark):
    empty = movie(spark, np.zeros((0, 3)), 1) if False else spark.createDataFrame([], "px long, r int, c int, trace array<double>")
    w, h, errors = factors.nonnegative_factors(empty, 2)
    assert w.collect() == [] and h.shape == (2, 0) and errors == []
    assert factors.background_model(empty, "svd", 3)[1].shape == (3, 0)
    foot, traces = spark.createDataFrame([], "k long, px long, w double"), spark.createDataFrame([], "k long, c array<double>")
    assert factors.product_factors(foot, traces, 2)[0].collect() == []
