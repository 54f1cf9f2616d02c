"""Resampling, level curves, volumes of patches, pluggable classifiers and the constrained fit against dense forms."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.operators import components, contours, linalg, numerics, patches, quality, resample, spikes


def dense_axis(n, m, scale):
    """Weights of one axis, sample by sample."""
    out = np.zeros((m, n))
    u = max(1.0, 1 / scale)
    for i in range(m):
        x = (i + 0.5) / scale - 0.5
        for p in range(int(np.floor(x - 2 * u)) - 1, int(np.ceil(x + 2 * u)) + 2):
            a = abs(x - p) / u
            w = 1.5 * a**3 - 2.5 * a**2 + 1 if a <= 1 else -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2 if a <= 2 else 0.0
            q = p
            while not 0 <= q < n:
                q = -1 - q if q < 0 else 2 * n - 1 - q
            out[i, q] += w
    return out / out.sum(axis=1, keepdims=True)


def movie_of(spark, cube):
    rows = [(r * cube.shape[1] + c, r, c, cube[r, c].tolist()) for r in range(cube.shape[0]) for c in range(cube.shape[1])]
    return spark.createDataFrame(rows, "px long, r int, c int, trace array<double>")


@pytest.mark.parametrize(("shape", "scale"), [((71, 40), 0.5), ((37, 70), 1 / 3), ((35, 9), 1.5), ((5, 3), 0.25), ((1, 1), 2.0), ((33, 34), 1.0)])
def test_resized_across_blocks(spark, shape, scale):
    cube = np.random.default_rng(0).normal(size=(*shape, 2))
    out = [int(np.ceil(n * scale)) for n in shape]
    want = np.einsum("ij,kl,jlt->ikt", dense_axis(shape[0], out[0], scale), dense_axis(shape[1], out[1], scale), cube)
    got = np.full(want.shape, np.nan)
    rows = resample.resized(movie_of(spark, cube), *shape, scale).collect()
    for x in rows:
        got[x.r, x.c] = x.trace
    assert len(rows) == out[0] * out[1] and np.allclose(got, want)


def test_resized_edges(spark):
    empty = spark.createDataFrame([], "r int, c int, trace array<double>")
    assert resample.resized(empty, 4, 4, 0.5).count() == 0
    flat = resample.resized(movie_of(spark, np.full((9, 11, 1), 3.0)), 9, 11, 0.4)
    assert all(x.trace[0] == pytest.approx(3.0) for x in flat.collect())
    missing = movie_of(spark, np.ones((4, 4, 1))).withColumn("trace", F.when(F.expr("px <> 5"), F.col("trace")))
    assert resample.resized(missing, 4, 4, 1.0).where("r = 1 and c = 1").first().trace[0] == pytest.approx(0.0)


def test_resized_traces(spark):
    y = np.array([0.0, 0.0, 5.0, 0.0, 0.0, 1.0])
    d = spark.createDataFrame([(1, y.tolist()), (2, [])], "k long, c array<double>")
    got = {r.k: r.c for r in resample.resized_traces(d, 15).collect()}
    assert np.allclose(got[1], dense_axis(6, 15, 2.5) @ y) and min(got[1]) < 0 and got[2] == []
    got = {r.k: r.c for r in resample.resized_traces(d, 15, floor=0.0, quiet=0.5).collect()}[1]
    assert min(got) == 0 and all(x == 0 or x >= 0.5 for x in got)


def area(path):
    r, c = path[:, 0], path[:, 1]
    return abs(r @ np.roll(c, -1) - c @ np.roll(r, -1)) / 2


def test_paths_of_a_disc_a_ring_and_a_saddle():
    y, x = np.mgrid[:41, :41]
    d = np.hypot(y - 20, x - 20)
    (disc,) = contours.level_paths(15 - d, 5.0)
    assert np.allclose(np.hypot(*(disc - 20).T), 10, atol=0.05) and area(disc) == pytest.approx(np.pi * 100, rel=0.01)
    ring = contours.level_paths(5 - np.abs(d - 12), 2.0)
    assert sorted(round(area(p)) for p in ring) == pytest.approx([np.pi * 81, np.pi * 225], rel=0.02)
    low = contours.level_paths(np.array([[1.0, 0.0], [0.0, 1.0]]), 0.6)
    high = contours.level_paths(np.array([[1.0, 0.0], [0.0, 1.0]]), 0.4)
    assert (len(low), len(high)) == (2, 1)
    for path in [disc, *ring, *low, *high]:
        assert (np.abs(path - np.roll(path, -1, axis=0)) <= 1 + 1e-9).all()
    edge = contours.level_paths(np.ones((3, 3)), 0.5)
    assert len(edge) == 1 and len(edge[0]) == 12
    assert contours.level_paths(np.zeros((3, 3)), 0.5) == []


def test_energy_level_and_median():
    rng = np.random.default_rng(1)
    w = rng.random(50)
    level = contours.energy_level(w, 0.9)
    kept = np.sort(w[w >= level])
    assert (kept**2).sum() >= 0.9 * (w**2).sum() > (kept[1:] ** 2).sum()
    a = rng.random((5, 6))
    full = np.pad(a, 1)
    assert np.allclose(contours.median3(a), [[np.median(full[i : i + 3, j : j + 3]) for j in range(6)] for i in range(5)])


def test_contours_of_footprints(spark):
    y, x = np.mgrid[:30, :20]
    blob = np.maximum(0, 6 - np.hypot(y - 12, x - 9))
    other = blob.copy()
    other[25:28, 2:5] = 9.0
    rows = [(k, int(c * 30 + r), float(a[r, c])) for k, a in ((1, blob), (2, other)) for r, c in np.argwhere(a > 0)] + [(3, 7, 1.0), (4, 8, 0.0)]
    foot = spark.createDataFrame(rows, "k long, px long, w double").withColumn("path", F.lit("x"))
    d = contours.contours(foot, 30)
    count = {r.k: r.n for r in d.groupBy("k").agg(F.countDistinct("path").alias("n")).collect()}
    assert count == {1: 1, 2: 2}  # a single pixel has no median
    alone = contours.contours(foot, 30, method="max", share=0.1, median=False).groupBy("k").agg(F.countDistinct("path").alias("n"), F.avg("r").alias("r")).collect()
    assert {r.k: (r.n, round(r.r)) for r in alone} == {1: (1, 12), 2: (1, 12), 3: (1, 7)}
    out = {r.k: json.loads(r.json) for r in contours.footprint_json(foot.drop("path"), d, 30).collect()}
    assert out[1]["centroid"] == pytest.approx([12, 9]) and out[1]["bbox"] == [7, 17, 4, 14] and len(out[1]["pixels"]) == int((blob > 0).sum())
    points = np.array(out[1]["contours"][0])
    assert np.allclose(points.mean(axis=0), [12, 9], atol=0.3) and out[3]["contours"] == [] and out[4]["centroid"] == [None, None]
    assert contours.contours(foot.where("false"), 30).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        contours.contours(foot, 30, method="area")


def test_patches_of_a_volume(spark):
    """A volume of 20 x 18 x 7 places and 60 frames, fitted patch by patch."""
    rng = np.random.default_rng(2)
    shape, trace = (20, 18, 7), rng.random((2, 60))
    cube = np.zeros((*shape, 60))
    cube[3:6, 3:6, 1:3] += trace[0]
    cube[13:17, 11:14, 4:7] += trace[1]
    rows = [(int(r + 20 * (c + 18 * z)), int(r), int(c), int(z), cube[r, c, z].tolist()) for r, c, z in np.ndindex(shape)]
    px = spark.createDataFrame(rows, "px long, r int, c int, z int, trace array<double>")
    grid = patches.patch_boxes(spark, r=(20, 12, 4, 5), c=(18, 18, 0, 3), z=(7, 4, 1, 2))
    assert [tuple(g)[1:] for g in grid.orderBy("patch").collect()] == [(a, b, 0, 17, c, d) for c, d in ((0, 3), (3, 6)) for a, b in ((0, 11), (8, 19))]
    seen = patches.coverage_mean(patches.patch_pixels(grid).withColumn("value", F.lit(1.0)), "r", "c", "z")
    assert {(r.r, r.c, r.z): r.n for r in seen.collect()} == {(r, c, z): (2 if 8 <= r <= 11 else 1) * (2 if z == 3 else 1) for r, c, z in np.ndindex(shape)}

    def fit(pdf):
        y = np.stack(pdf["trace"])
        u, s, _ = np.linalg.svd(y, full_matrices=False)
        w = np.abs(u[:, 0]) * (s[0] > 1e-9)
        out = pdf[["patch", "px"]].assign(k=pdf.patch.astype("int64"), w=w)
        return out[out.w > 1e-9][["patch", "k", "px", "w"]]

    foot = patches.by_patch(px, grid, fit, "patch int, k long, px long, w double")
    centres = {r.k: (r.r, r.c, r.z) for r in linalg.centers(foot, 20, 18).collect()}
    assert centres[0] == pytest.approx((4, 4, 1.5)) and centres[3] == pytest.approx((14.5, 12, 5)) and set(centres) == {0, 3}


def test_classifiers(spark):
    foot = spark.createDataFrame([(1, 45, 1.0), (1, 46, 1.0), (2, 5, 3.0)], "k long, px long, w double")
    crops = components.crops(foot, 10, 2)
    assert {tuple(r) for r in quality.classified(crops, 2).collect()} == {(1, 1.0, True), (2, 1.0, True)}
    shapes = quality.classified(crops, 2, lambda a: np.where((a > 0).sum(axis=(1, 2)) > 1, 0.9, np.nan))
    assert {r.k: r.keep for r in shapes.collect()} == {1: True, 2: False}
    assert quality.classified(crops.where("false"), 2).count() == 0


def least_sum(y, g, noise, low):
    """Reference: the penalty by plain bisection over dense non-negative least squares."""
    n, h = len(y), numerics.ar2_response(g[0], g[1] if len(g) > 1 else 0.0, len(y))
    pole = max(abs(np.roots([1.0, *(-x for x in g)])))
    a = np.array([[h[i - j] if i >= j else 0.0 for j in range(1, n)] + [1.0, pole**i] for i in range(n)])
    cost = np.append(np.ones(n - 1), [0.0, 0.0])
    down, up = 0.0, 1e3
    for _ in range(60):
        lam = (down + up) / 2
        x = numerics.nnls_normal(a.T @ a, a.T @ (y - low) - lam * cost)
        down, up = (lam, up) if ((y - low - a @ x) ** 2).sum() <= noise**2 * n else (down, lam)
    return x[:-2].sum(), x[-2] + low, x[-1]


@pytest.mark.parametrize("g", [(0.9,), (1.4, -0.48)])
def test_constrained_fit(g):
    rng = np.random.default_rng(4)
    n, pole = 150, max(abs(np.roots([1.0, *(-x for x in g)])))
    truth = (rng.random(n) < 0.05) * rng.uniform(1, 2, n)
    c = np.convolve(truth, numerics.ar2_response(g[0], g[1] if len(g) > 1 else 0.0, n))[:n]
    y = c + 2.0 + 1.5 * pole ** np.arange(n) + 0.3 * rng.normal(size=n)
    fit = spikes.constrained_fit(y, g, 0.3)
    rest = y - np.array(fit["c"]) - fit["base"] - fit["first"] * pole ** np.arange(n)
    assert fit["settled"] and rest @ rest == pytest.approx(0.09 * n, rel=1e-5)
    total, base, first = least_sum(y, g, 0.3, float(y.min()))
    assert (sum(fit["s"]), fit["base"], fit["first"]) == (pytest.approx(total, rel=1e-3), pytest.approx(base, rel=1e-3), pytest.approx(first, rel=1e-2))
    assert abs(fit["base"] - 2.0) < 0.4 and np.corrcoef(fit["c"], c)[0, 1] > 0.95
    held = spikes.constrained_fit(y, g, 0.35, base=2.0, first=1.5)
    assert held["base"] == 2.0 and held["first"] == 1.5 and np.corrcoef(held["c"], c)[0, 1] > 0.95
    scaled = spikes.constrained_fit(1e4 * y, g, 3e3)
    assert np.allclose(scaled["s"], 1e4 * np.array(fit["s"]), atol=1.0)


def test_constrained_fit_edges():
    assert spikes.constrained_fit(np.zeros(0), (0.9,), 1.0)["s"] == []
    flat = spikes.constrained_fit(np.full(20, 3.0), (0.9,), 0.1)
    assert max(flat["s"]) == 0 and flat["base"] == pytest.approx(3.0)
    assert max(spikes.constrained_fit(np.random.default_rng(0).normal(size=40), (0.9,), 50.0)["s"]) == 0
    far = spikes.constrained_fit(np.random.default_rng(0).normal(size=40), (0.9,), 1e-6)
    assert not far["settled"] and far["lam"] == 0
    gaps = np.sin(np.arange(60) / 5) + 1
    gaps[[0, 7, 8, 59]] = np.nan
    assert np.isfinite(spikes.constrained_fit(gaps, (0.9,), 0.1)["c"]).all()
    assert spikes.constrained_fit(np.full(5, np.nan), (0.9,), 0.1)["s"] == [0.0] * 5
