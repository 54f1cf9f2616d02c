"""What tasks hold and shuffle follows the footprints, not the cells around them or the samples of their movie."""

import numpy as np
from pyspark.sql import functions as F

from glimmer.operators import contours, graphs, linalg, quality, updates


def plan_of(d) -> str:
    return d._jdf.queryExecution().optimizedPlan().toString()


def blob(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(p), float(w)) for k in range(4) for p, w in zip(rng.choice(600, 150, replace=False), rng.random(150) + 0.1, strict=True)]
    return rows, spark.createDataFrame(rows, "k long, px long, w double")


def test_neighbours_are_no_rows(spark):
    """F18 contour_pixels, F26 search_locations_dilate."""
    rows, foot = blob(spark)
    near, outline = updates.search_locations(foot, 20, 30, 2), updates.contour_pixels(foot, 20, 0.4)
    assert "Generate" not in plan_of(near) + plan_of(outline)
    want, edge = set(), set()
    for k in range(4):
        own = {(p % 20, p // 20): w for j, p, w in rows if j == k}
        mask = {x for x, w in own.items() if w > 0.4 * max(own.values())}
        want |= {(k, (c + b) * 20 + r + a) for r, c in own for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4 and 0 <= r + a < 20 and 0 <= c + b < 30}
        edge |= {(k, c * 20 + r) for r, c in mask if not {(r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)} <= mask}
    assert sorted(map(tuple, near.collect())) == sorted(want) and sorted(map(tuple, outline.collect())) == sorted(edge)


def test_mean_images_need_no_samples_as_rows(spark):
    """F12 frame_exclusion_corr."""
    rows, foot = blob(spark)
    rng = np.random.default_rng(6)
    y = rng.random((500, 9))
    pixels = spark.createDataFrame([(i, y[i].tolist()) for i in range(500)], "px long, trace array<double>")
    frames = spark.createDataFrame([(0, 1), (0, 4), (1, 8), (1, 20), (2, 30)], "k long, t int")
    d = quality.spatial_match(frames, foot, pixels)
    assert "posexplode" not in plan_of(d)
    got = {r["k"]: r for r in d.collect()}
    for k, t in ((0, [1, 4]), (1, [8])):
        own = [(p, w) for j, p, w in rows if j == k and p < 500]
        rho = np.corrcoef([y[p][t].mean() for p, _ in own], [w for _, w in own])[0, 1]
        assert got[k]["n"] == len(own) and abs(got[k]["rho"] - rho) < 1e-9
    assert set(got) == {0, 1}


def test_paths_are_rows(spark):
    """F19 contour_points, F24 contour_paths_closed: a path is packed where it arises, and costs no shuffle of its points."""
    _, foot = blob(spark)
    d = contours.contour_paths(foot, 20, 0.9, median=False)
    assert plan_of(d).count("Aggregate") == 0 and all(len(r["r"]) == len(r["c"]) >= 4 for r in d.collect())
    points = contours.contours(foot, 20, 0.9, median=False)
    assert points.count() == d.agg(F.sum(F.size("r"))).first()[0] and points.groupBy("k", "path", "i").count().where("count > 1").count() == 0


def test_curves_of_a_wide_footprint_are_quick():
    """this image took 0.75 s before, 0.11 s after."""
    import time

    a = (np.random.default_rng(1).random((40, 1000)) < 0.15).astype(float)
    began = time.process_time()
    paths = contours.level_paths(a, 0.5)
    assert sum(map(len, paths)) > 15_000 and time.process_time() - began < 0.2


def test_blocks_of_pairs_are_parts(spark, monkeypatch):
    """F23 frame_exclusion: pairs are formed once, and blocks of them are not dealt to a fixed number of parts."""
    monkeypatch.setattr(linalg, "TASK_PAIRS", 20)
    rows, foot = blob(spark)
    edges = linalg.cosine_edges(foot, 0.2)
    own = [(0, 1), (0, 2), (1, 2), (2, 2), (3, 7)]
    d = quality.exclusive_frames(spark.createDataFrame(own, "k long, t int"), edges)
    assert plan_of(d).count("FlatMapGroupsInArrow") == 1
    assert int(plan_of(d).split("RepartitionByExpression [block", 1)[1].split("], ", 1)[1].split()[0]) > 20
    assert "RepartitionByExpression [px" in plan_of(d)
    vectors = [{p: w for j, p, w in rows if j == k} for k in range(4)]
    cosine = lambda a, b: sum(w * b.get(p, 0.0) for p, w in a.items()) / np.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))
    linked = {(i, j) for i in range(4) for j in range(4) if i != j and cosine(vectors[i], vectors[j]) > 0.2}
    want = {(k, t) for k, t in own if not any((k, j) in linked and (j, t) in own for j in range(4))}
    assert linked and {tuple(r) for r in d.collect()} == want != set(own)


def test_impossible_pairs_of_sessions_are_no_rows(spark, monkeypatch):
    """F29 register_sessions: pairs are counted in blocks, on repeated rows, nulls and empty sides as well."""
    monkeypatch.setattr(graphs, "TASK_PAIRS", 40)
    rng = np.random.default_rng(8)
    sides = [[(int(k) - 3, int(p)) for k in range(12) for p in rng.choice(60, rng.integers(1, 30))] + [(None, 5), (3, None), (20 + i, 70)] for i in range(2)]
    first, second = (spark.createDataFrame(x, "k long, px long") for x in sides)
    size = [{k: sum(j == k for j, _ in x) for k, _ in x} for x in sides]
    shared = {}
    for a, p in sides[0]:
        for b, q in sides[1]:
            if None not in (a, b, p, q) and p == q:
                shared[a, b] = shared.get((a, b), 0) + 1
    for exponent, contained, most in ((1.0, 0.8, 0.9), (0.5, 0.6, 0.5), (1.0, 2.0, 1.0)):
        d = graphs.session_distances(first, second, exponent, contained, most)
        assert "Join" not in plan_of(d) and "FlatMapGroupsInArrow" in plan_of(d)
        want = {(a, b): 0.0 if n >= contained * min(size[0][a], size[1][b]) else 1 - (n / (size[0][a] + size[1][b] - n)) ** exponent for (a, b), n in shared.items()}
        want = {key: x for key, x in want.items() if x <= most}
        got = {(r["k1"], r["k2"]): r["d"] for r in d.collect()}
        assert want and got.keys() == want.keys() and all(abs(got[key] - want[key]) < 1e-12 for key in want)
    assert graphs.session_distances(first.limit(0), second, 1.0, 0.8, 0.9).collect() == []
