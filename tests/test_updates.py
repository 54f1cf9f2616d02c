"""Updates, neighbourhood filters and estimates without an SQL twin, against plain numpy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.operators import images, linalg, numerics, quality, traces, updates
from glimmer.plans import fit as plan

ROWS, COLUMNS, FRAMES = 34, 36, 60


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(2).normal(1, 0.3, (ROWS, COLUMNS, FRAMES))


def pixels_of(spark, cube):
    rows = [(r * cube.shape[1] + c, r, c, cube[r, c].tolist()) for r in range(cube.shape[0]) for c in range(cube.shape[1])]
    return spark.createDataFrame(rows, "px long, r int, c int, trace array<double>").repartition(5)


@pytest.fixture(scope="module")
def pixels(spark, cube):
    return pixels_of(spark, cube).cache()


@pytest.fixture(scope="module")
def factors():
    rng = np.random.default_rng(7)
    a = np.zeros((ROWS * COLUMNS, 9))
    for k in range(9):
        r, c = rng.integers(3, ROWS - 3), rng.integers(3, COLUMNS - 3)
        for i in range(r - 3, r + 3):
            a[i * COLUMNS + c - 3 : i * COLUMNS + c + 3, k] = rng.random(6) + 0.1
    a[:, 8] = a[:, 7] * rng.random(len(a))
    return a, rng.random((9, FRAMES))


def frames_of(spark, a, c):
    foot = [(int(k), int(p), float(a[p, k])) for p, k in zip(*np.nonzero(a), strict=True)]
    return spark.createDataFrame(foot, "k long, px long, w double"), spark.createDataFrame([(k, c[k].tolist()) for k in range(len(c))], "k long, c array<double>")


def test_update_order_and_hals(spark, cube, pixels, factors):
    a, c = factors
    foot, tr = frames_of(spark, a, c)
    g = linalg.gram(foot)
    step = {r["k"]: r["step"] for r in updates.update_order(g.where("k1 <> k2"), tr).collect()}
    v = a.T @ a
    assert set(step) == set(range(9))
    for i in range(9):
        near = [step[j] for j in range(9) if j != i and v[i, j] > 0]
        assert step[i] not in near and all(s in near for s in range(step[i])) or step[i] == 0 and 0 not in near
    want, u = c.copy(), a.T @ cube.reshape(-1, FRAMES)
    for _ in range(2):
        for k in sorted(step, key=lambda k: (step[k], k)):
            want[k] = np.maximum(0, want[k] + (u[k] - v[k] @ want) / v[k, k])
    got = {r["k"]: r["c"] for r in updates.temporal_hals(foot, pixels, tr, 2, 0.0).collect()}
    assert np.allclose([got[k] for k in range(9)], want)


def test_spatial_update_recovers_footprints(spark, factors):
    a, c = factors
    a, c = a[:, :8], c[:8]
    foot, tr = frames_of(spark, a, c)
    y = (a @ c).reshape(ROWS, COLUMNS, FRAMES) + np.random.default_rng(1).normal(0, 0.01, (ROWS, COLUMNS, FRAMES))
    px = pixels_of(spark, y).withColumn("noise", F.lit(0.01))
    near = updates.search_locations(foot, COLUMNS, ROWS, 2)
    got = np.zeros_like(a)
    for r in updates.update_spatial(px, near, tr).collect():
        got[r["px"], r["k"]] = r["w"]
    assert np.abs(got - a).max() < 0.05 and not ((got > 0.02) & (a == 0)).any()


def test_thresholded_footprints(spark):
    def one(points, **how):
        d = spark.createDataFrame([(1, c * 20 + r, float(w)) for r, c, w in points], "k long, px long, w double")
        return {(r["px"] % 20, r["px"] // 20): r["w"] for r in updates.thresholded_footprints(d, 20, **how).collect()}

    large = [(r, c, 1.0) for r in range(3) for c in range(4)]
    small = [(r, c, 5.0) for r in range(10, 12) for c in range(10, 12)]
    assert set(one(large + small, energy=1 - 1e-12, close=0, median=0)) == {(r, c) for r, c, _ in small}  # most energy
    assert set(one(large + small, share=0.1, close=0, median=0, method="max")) == {(r, c) for r, c, _ in large}  # most pixels
    dim = [(5, 5, 0.001)]
    assert (5, 5) not in one(small + dim, energy=0.999, close=0, median=0)
    ring = [(r, c, 1.0) for r in range(5, 8) for c in range(5, 8) if (r, c) != (6, 6)]
    assert len(one(ring, energy=1 - 1e-12, close=1, median=0)) == 8  # the closed hole has no weight of its own
    full = [(r, c, 1.0) for r in range(5, 9) for c in range(5, 9)]
    assert (5, 5) not in one(full, energy=1 - 1e-12, close=0, median=1) and (6, 6) in one(full, energy=1 - 1e-12, close=0, median=1)


def test_background_is_the_rank_one_fit(spark, pixels, cube):
    y = np.maximum(cube, 0).reshape(-1, FRAMES)
    b, f = updates.rank_one_background(pixels_of(spark, np.maximum(cube, 0)), 200, 1e-10)
    got = np.zeros(len(y))
    for r in b.collect():
        got[r["px"]] = r["b"]
    u, s, v = np.linalg.svd(y, full_matrices=False)
    assert np.allclose(np.outer(got, f), s[0] * np.outer(u[:, 0], v[0]), atol=1e-4)
    empty, none = updates.rank_one_background(pixels.limit(0))
    assert empty.count() == 0 and len(none) == 0


def test_leading_factors(spark, pixels, cube):
    y = cube.reshape(-1, FRAMES)
    u, s, v = linalg.leading_factors(pixels, 2, rounds=60)
    want = np.linalg.svd(y, full_matrices=False)
    assert np.allclose(s[0], want[1][0]) and np.allclose(s[1], want[1][1], rtol=0.03)  # noise: the second is hardly larger than the third
    first = {r["px"]: r["u"][0] for r in u.collect()}
    assert np.allclose(np.abs([first[i] for i in range(len(y))]), np.abs(want[0][:, 0]), atol=1e-6)


def test_peak_to_noise_and_filter(spark, pixels, cube):
    kernel = images.centre_surround(7, 1.5)
    assert abs(kernel.sum()) < 1e-12 and kernel.shape == (7, 7)
    padded = np.pad(cube, ((3, 3), (3, 3), (0, 0)), mode="edge")
    want = sum(kernel[i, j] * padded[i : i + ROWS, j : j + COLUMNS] for i in range(7) for j in range(7))
    want = (want - np.median(want, axis=2, keepdims=True)).reshape(-1, FRAMES)
    got = {r["px"]: r for r in images.peak_to_noise(pixels, kernel, ROWS, COLUMNS, 1.0).collect()}
    assert len(got) == ROWS * COLUMNS
    for p in (0, 35, 500, 33 * 36, 34 * 36 - 1, 32 * 36 + 31, 31 * 36 + 32):
        noise = numerics.noise_level(want[p])
        assert abs(got[p]["pnr"] - want[p].max() / noise) < 1e-9
        assert np.allclose(got[p]["trace"], np.where(want[p] >= noise, want[p], 0))


def test_ring_background(spark, pixels, cube):
    noise = pixels.select("px", F.lit(0.25).alias("sn"))
    got = {r["px"]: np.array(r["trace"]) for r in images.ring_background(pixels, 2, noise, level=2.0).collect()}
    assert len(got) == ROWS * COLUMNS
    ring = [(a, b) for a in range(-3, 4) for b in range(-3, 4) if 2 <= np.hypot(a, b) < 3]
    z = cube - cube.mean(axis=2, keepdims=True)
    near = lambda r, c: [(r + a, c + b) for a, b in ring if 0 <= r + a < ROWS and 0 <= c + b < COLUMNS]
    around = np.zeros_like(z)
    for r in range(ROWS):
        for c in range(COLUMNS):
            around[r, c] = np.mean([z[p] for p in near(r, c)], axis=0)
    event = z - around > 2.0 * 0.25
    calm = np.where(event, around, z)
    for r, c in ((0, 0), (31, 31), (32, 32), (33, 35), (15, 20)):
        x = np.array([calm[p] for p in near(r, c)])
        kept = ~event[r, c]
        kept[0] = False
        xx = x[:, kept] @ x[:, kept].T
        w = np.linalg.solve(xx + np.eye(len(x)) * np.trace(xx) * 1e-5, x[:, kept] @ calm[r, c, kept])
        assert np.allclose(got[r * COLUMNS + c], w @ x + cube[r, c].mean())


def test_images_over_several_tiles(spark, pixels, cube):
    """Blur and correlation across tile edges, and the maximum over blocks."""
    taps = np.array(images.gaussian_taps(1.2, 2))
    padded = np.pad(cube, ((2, 2), (2, 2), (0, 0)))
    want = sum(taps[i] * taps[j] * padded[i : i + ROWS, j : j + COLUMNS] for i in range(5) for j in range(5))
    got = {r["px"]: r["trace"] for r in images.blurred(pixels, 1.2, 2).collect()}
    assert np.allclose([got[p] for p in range(ROWS * COLUMNS)], want.reshape(-1, FRAMES))
    best = np.full((ROWS, COLUMNS), -np.inf)
    for part in (cube[:, :, :25], cube[:, :, 25:]):
        z = (part - part.mean(axis=2, keepdims=True)) / part.std(axis=2, keepdims=True)
        rho, n = np.zeros((ROWS, COLUMNS)), np.zeros((ROWS, COLUMNS))
        for a, b in images.EIGHT:
            for r in range(max(0, -a), min(ROWS, ROWS - a)):
                for c in range(max(0, -b), min(COLUMNS, COLUMNS - b)):
                    rho[r, c] += (z[r, c] * z[r + a, c + b]).mean()
                    n[r, c] += 1
        best = np.maximum(best, rho / n)
    got = {r["px"]: r["rho"] for r in images.correlation_image(pixels, images.EIGHT, 25, 10).collect()}
    assert np.allclose([got[p] for p in range(ROWS * COLUMNS)], best.ravel())


def test_diffusion_density():
    rng = np.random.default_rng(0)
    y = np.concatenate([rng.normal(0, 1, 6000), rng.normal(8, 1, 1500)])
    grid, density, cdf = numerics.diffusion_density(y)
    assert abs(np.trapezoid(density, grid) - 1) < 1e-3 and abs(cdf[-1] - 1) < 1e-6
    truth = 0.8 * np.exp(-(grid**2) / 2) / np.sqrt(2 * np.pi) + 0.2 * np.exp(-((grid - 8) ** 2) / 2) / np.sqrt(2 * np.pi)
    assert np.abs(density - truth).max() < 0.03
    assert np.abs(cdf - np.searchsorted(np.sort(y), grid, "right") / len(y)).max() < 0.03
    assert numerics.kde_mode(np.full(10, 3.0)) == {"mode": 3.0, "level": 1.0}


@pytest.mark.parametrize("n", [150, 1200])
def test_convolution_nnls_is_optimal(n):
    rng = np.random.default_rng(n)
    kernel = numerics.ar2_response(1.7, -0.712, 200)
    y = np.convolve((rng.random(n) < 0.05) * rng.uniform(0.5, 2, n), kernel)[:n] + rng.normal(0, 0.3, n)
    c, s = numerics.convolution_nnls(y, kernel, 0.05)
    lag = np.arange(n)[:, None] - np.arange(n)[None, :]
    k = np.where((lag >= 0) & (lag < 200), kernel[np.clip(lag, 0, 199)], 0.0)
    slope = k.T @ (y - 0.05 - k @ s)
    assert np.allclose(c, k @ s) and (s >= 0).all() and slope.max() < 1e-6 and np.abs(slope[s > 0]).max() < 1e-6
    c, s = numerics.thresholded_spikes(y, kernel, 0.4)
    assert s[s > 0].min() >= 0.4


@pytest.mark.parametrize("kind", ["ar1", "ar2", "exp2", "kernel"])
@pytest.mark.parametrize("method", ["foopsi", "constrained", "thresholded"])
def test_deconvolution_finds_spikes(kind, method):
    rng = np.random.default_rng(4)
    n, at = 500, np.arange(30, 480, 45)
    pars = {"ar1": [0.9], "ar2": [1.6, -0.65], "exp2": [0.95, 0.5], "kernel": numerics.two_exponentials(0.95, 0.5, 100)}[kind]
    kernel = 0.9 ** np.arange(n) if kind == "ar1" else numerics.ar2_response(1.6, -0.65, n) if kind == "ar2" else numerics.two_exponentials(0.95, 0.5, n)
    s = np.zeros(n)
    s[at] = 2.0
    y = 0.5 + np.convolve(s, kernel)[:n] + rng.normal(0, 0.1, n)
    got = numerics.deconvolve(y, kind, method, pars, noise=0.1, lam=0.01, smin=0.0 if kind == "ar1" else 0.8, base=0.5)
    near = np.convolve(got["s"], np.ones(5), "same")
    assert (near[at] > 1.2).all()
    assert np.sqrt(((y - 0.5 - got["c"]) ** 2).mean()) < 0.16


def test_baseline_of_foopsi():
    rng = np.random.default_rng(5)
    y = 3 + numerics.oasis_ar1(np.convolve((rng.random(800) < 0.02) * 2.0, 0.9 ** np.arange(50))[:800], 0.9)[0] + rng.normal(0, 0.1, 800)
    c, s, b = numerics.foopsi_ar1(y, 0.9, 0.1)
    assert abs((y - c).mean() - b) < 1e-5 and (s[1:] >= -1e-9).all()


def test_welch_noise():
    y = np.random.default_rng(0).normal(0, 2, 20_000) + np.sin(np.arange(20_000) / 300) * 20
    assert all(abs(numerics.welch_noise(y, how=how) - 2) < 0.15 for how in ("mean", "logmexp", "median"))


def test_extract_dff(spark, cube, pixels, factors):
    a, c = factors
    foot, tr = frames_of(spark, a, c)
    base = tr.select("k", F.lit(0.1).alias("base"))
    got = {r["k"]: r for r in traces.extract_dff(tr, linalg.product_ay(foot, pixels), linalg.gram(foot), base, 0.5).collect()}
    v = a.T @ a
    left = a.T @ cube.reshape(-1, FRAMES) - (v - np.diag(np.diag(v))) @ c
    for k in range(9):
        assert abs(got[k]["df"] - np.median(left[k])) < 1e-9
        assert np.allclose(got[k]["c"], (c[k] - 0.1) * v[k, k] / np.median(left[k]))


def test_active_pixels(spark):
    rng = np.random.default_rng(3)
    cube = rng.normal(0, 1, (10, 10, 128))
    cube[:4] = np.cumsum(cube[:4], axis=2)
    got = {r["px"]: r["active"] for r in quality.active_pixels(pixels_of(spark, cube)).collect()}
    assert sum(got[p] == (p < 40) for p in range(100)) >= 97


def test_register_sessions(spark):
    square = lambda r, c: [(r + i) * 50 + c + j for i in range(4) for j in range(4)]
    places = [[(5, 5), (20, 20), (40, 40)], [(20, 20), (5, 6), (30, 5)], [(30, 5), (40, 40), (12, 12)]]
    sessions = [spark.createDataFrame([(k, p, 1.0) for k, at in enumerate(s) for p in square(*at)], "k long, px long, w double") for s in places]
    got = {(r["session"], r["k"]): r["u"] for r in plan.register_sessions(sessions, 0.1, most=0.9).collect()}
    assert len(got) == 9
    same = [[(0, 0), (1, 1)], [(0, 1), (1, 0)], [(0, 2), (2, 1)], [(1, 2), (2, 0)], [(2, 2)]]
    assert all(len({got[x] for x in group}) == 1 for group in same) and len(set(got.values())) == 5


def test_refined_pipeline(spark):
    """Three cells over a shared background: each is found, with its pixels and its trace."""
    rng = np.random.default_rng(6)
    rows, columns, frames = 24, 24, 300
    y = rng.normal(0, 0.1, (rows, columns, frames)) + np.linspace(2, 1, frames)
    truth = []
    for r, c in ((6, 6), (16, 15), (6, 17)):
        trace = np.convolve((rng.random(frames) < 0.03) * rng.uniform(1, 2, frames), 0.9 ** np.arange(40))[:frames] * 3
        y[r - 2 : r + 3, c - 2 : c + 3] += trace
        truth.append(((r, c), trace))
    options = plan.FitOptions(patch=16, overlap=6, components=3)
    got = plan.refined(pixels_of(spark, y), rows, columns, options).collect()
    assert got and len({r["k"] for r in got}) == len(got)
    for (r, c), trace in truth:
        best = max(got, key=lambda x: np.corrcoef(x["c"], trace)[0, 1] if np.std(x["c"]) else -1)
        assert np.corrcoef(best["c"], trace)[0, 1] > 0.9
        own = {(p // columns, p % columns) for p in best["px"]}
        assert len(own & {(i, j) for i in range(r - 2, r + 3) for j in range(c - 2, c + 3)}) >= 15


def test_regressions(spark, cube, pixels, factors):
    a, c = factors[0][:, :8], factors[1][:8]
    foot, tr = frames_of(spark, a, c)
    y = cube.reshape(-1, FRAMES)
    got = {r["k"]: r["c"] for r in updates.regressed_traces(foot, pixels).collect()}
    want = np.maximum(np.linalg.lstsq(a, y, rcond=None)[0], 0)
    assert np.allclose([got[k] for k in range(8)], want, atol=1e-6)
    w = np.zeros_like(a)
    for r in updates.regressed_footprints(pixels, foot, tr).collect():
        w[r["px"], r["k"]] = r["w"]
    for p in np.flatnonzero(a.any(axis=1)):
        own = np.flatnonzero(a[p])
        assert np.allclose(w[p, own], np.maximum(np.linalg.lstsq(c[own].T, y[p], rcond=None)[0], 0))


def test_trimmed_footprints(spark):
    square = [(r, c, 1.0) for r in range(5, 11) for c in range(5, 11)]
    tail = [(7, c, 0.9) for c in range(11, 18)]
    far = [(15, 15, 0.5)]
    d = spark.createDataFrame([(1, c * 20 + r, w) for r, c, w in square + tail + far] + [(2, 21, 1.0)], "k long, px long, w double")
    got = {(r["k"], r["px"] % 20, r["px"] // 20) for r in updates.trimmed_footprints(d, 20).collect()}
    assert got == {(1, r, c) for r, c, _ in square}


def test_exceedance():
    rng = np.random.default_rng(8)
    noise, active = rng.normal(0, 1, 2000), rng.normal(0, 1, 2000)
    active[500:520] += 6
    for tail, factor in (("gaussian", 3.0), ("extreme", 1.0)):
        a, b = numerics.exceedance(noise, 8, tail, factor), numerics.exceedance(active, 8, tail, factor)
        assert abs(a["mode"]) < 0.3 and 0.8 < a["noise"] < 1.25
        assert b["fitness"] < a["fitness"] if tail == "gaussian" else b["fitness"] > a["fitness"]


def test_seeded_start_under_background(spark):
    """Cells over a background that is much stronger and moves: seeds find them, one each."""
    rng = np.random.default_rng(9)
    rows, columns, frames = 40, 40, 400
    wave = np.convolve(rng.normal(0, 1, frames), np.ones(30) / 5, "same")
    r, c = np.mgrid[:rows, :columns]
    y = rng.normal(0, 0.3, (rows, columns, frames)) + (20 + 5 * np.sin(r / 15))[:, :, None] * (1 + 0.05 * wave)
    truth = []
    for i, j in ((10, 10), (10, 29), (28, 19)):
        trace = np.convolve((rng.random(frames) < 0.02) * rng.uniform(1, 2, frames), 0.9 ** np.arange(40))[:frames] * 4
        y += np.exp(-((r - i) ** 2 + (c - j) ** 2) / 6)[:, :, None] * trace
        truth.append(((i, j), trace))
    got = plan.start_seeded(pixels_of(spark, y), rows, columns, plan.FitOptions(patch=40, overlap=5, components=5), size=9, sigma=2.0, least_corr=0.5, least_pnr=6.0).collect()
    assert len(got) == 3
    for (i, j), trace in truth:
        best = max(got, key=lambda x: np.corrcoef(x["c"], trace)[0, 1])
        assert np.corrcoef(best["c"], trace)[0, 1] > 0.9
        p = best["px"][int(np.argmax(best["w"]))]
        assert abs(p // columns - i) <= 1 and abs(p % columns - j) <= 1
