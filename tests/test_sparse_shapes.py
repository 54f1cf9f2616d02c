"""Footprints far from compact: pieces and squares follow the pixels, not the box around them."""

import time

import numpy as np

from glimmer.operators import contours, updates


def test_pieces_against_flooding():
    rng = np.random.default_rng(3)
    for corners in (True, False):
        mask = rng.random((30, 40)) < 0.45
        cells = rng.permutation(np.argwhere(mask)) - 5
        at = {tuple(x): i for i, x in enumerate(cells.tolist())}
        want, n = {}, 0
        for start in sorted(at, key=lambda x: x[::-1]):
            if start in want:
                continue
            stack = [start]
            while stack:
                y, x = stack.pop()
                if (y, x) in at and (y, x) not in want:
                    want[y, x] = n
                    stack += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if corners or not i or not j]
            n += 1
        assert updates.sparse_pieces(cells, corners).tolist() == [want[tuple(x)] for x in cells.tolist()]
    snake = np.array([(i % 2 * 3000 if j == 0 else j, i) for i in range(2) for j in range(3001)])
    assert updates.sparse_pieces(snake).max() >= 0
    assert updates.sparse_pieces(np.zeros((0, 2), int)).tolist() == []


def test_footprint_over_a_wide_field(spark):
    """Pixels 400 million apart: a box around them would not fit, and the pieces are the same as of two near ones."""
    rows = 40
    near = [(1, 41 * i + 400, 10.0 + i) for i in range(4)] + [(1, 400_000_000 + i, 5.0) for i in range(2)]
    foot = spark.createDataFrame(near, "k long, px long, w double")
    began = time.time()
    want = {(px, w) for _, px, w in near[:4]}
    assert {(r["px"], r["w"]) for r in updates.thresholded_footprints(foot, rows, 0.999, close=0, median=0).collect()} == want
    peak = max(near, key=lambda x: x[2])
    assert [(r["px"], r["w"]) for r in updates.trimmed_footprints(foot, rows, half=0, least=1).collect()] == [peak[1:]]
    assert time.time() - began < 60


def test_largest_piece_keeps_its_place(spark):
    foot = spark.createDataFrame([(1, 40 * c + r, 3.0) for c in (20, 21) for r in (7, 8, 9)] + [(1, 5, 4.0)], "k long, px long, w double")
    got = contours.contours(foot, 40, 0.3, method="max", median=False).collect()
    assert {r["path"] for r in got} == {0} and len(got) == 10
    assert (min(r["r"] for r in got), max(r["c"] for r in got)) == (7 - 1 + 0.4, 21 + 0.6)


def test_the_query_smooths_by_a_median(spark):
    """F15 threshold_components: the median filter, the method's first step, was left out."""
    import duckdb

    import __spark_entry__ as driver

    data = "/root/testdata/sf0.001"
    images = {}
    for k, px, w in duckdb.sql(f"select l_suppkey, l_partkey, sum(l_quantity) from '{data}/lineitem.parquet' group by 1, 2").fetchall():
        images.setdefault(k, np.zeros((40, 60)))[px % 40, px // 40] = w
    got = driver.queries()["threshold_components"](spark, data).collect()
    assert {r["k"] for r in got} == set(images)
    for k, image in images.items():
        smooth = contours.median3(image)
        assert all(abs(smooth[r["px"] % 40, r["px"] // 40] - r["w"]) < 1e-6 for r in got if r["k"] == k)
