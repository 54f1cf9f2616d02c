"""What a pixel sends to blocks of pairs: one string for many pixels; sizes and norms only where there are too many of them."""

import numpy as np
import pytest

from glimmer.operators import factors, linalg


def test_strings_of_arrays():
    arrays = [np.arange(5, dtype=np.int32), np.zeros(0), np.array([1.5, -2.0]), np.array([1 << 40, -1])]
    data = linalg.packed_bytes(*arrays)
    got = linalg.unpacked_bytes(data, 8 * 4 + sum(x.nbytes for x in arrays), [x.dtype for x in arrays])
    assert all(np.array_equal(x, y) for x, y in zip(arrays, got, strict=True))


@pytest.mark.parametrize("norms", [0, 32 << 20])
def test_blocks_get_strings(spark, monkeypatch, norms):
    """F3, F7, F8, F10 to F13: each entry went to a block with its size and norm, 40 bytes a row and more."""
    monkeypatch.setattr(linalg, "TASK_PAIRS", 30)
    monkeypatch.setattr(linalg, "SENT_ENTRIES", 16)
    monkeypatch.setattr(linalg, "NORM_BYTES", norms)
    rng = np.random.default_rng(3)
    a = np.where(rng.random((50, 20)) < 0.3, rng.integers(1, 9, (50, 20)), 0).astype(float)
    foot = spark.createDataFrame([(int(k), int(p), float(a[p, k])) for p, k in np.argwhere(a)] + [(None, 3, 1.0), (4, None, 1.0)], "k long, px long, w double").repartition(3)
    d = linalg.overlaps(foot)
    assert "data#" in d._jdf.queryExecution().optimizedPlan().toString()
    v, n = a.T @ a, (a > 0).T.astype(int) @ (a > 0)
    want = {(i, j): (v[i, j], n[i, j], n[i, i], n[j, j], v[i, i], v[j, j]) for i, j in np.argwhere(np.triu(n)).tolist()}
    assert {(r["k1"], r["k2"]): tuple(r)[2:] for r in d.collect()} == want


@pytest.mark.parametrize("limit", [0, 32 << 20])
def test_product_sends_no_entry(spark, monkeypatch, limit):
    """F6 nmf_product: each of about 30 passes shuffled all entries of the footprints twice."""
    monkeypatch.setattr(factors, "NORM_BYTES", limit)
    monkeypatch.setattr(factors, "BLOCK_PIXELS", 8)
    rng = np.random.default_rng(5)
    a, b = np.where(rng.random((30, 7)) < 0.5, rng.random((30, 7)), 0), rng.normal(size=(7, 9))
    foot = spark.createDataFrame([(int(k), int(p), float(a[p, k])) for p, k in np.argwhere(a)] + [(50, 4, 1.0)], "k long, px long, a double")
    traces = spark.createDataFrame([(k, b[k].tolist()) for k in range(7)] + [(99, [1.0] * 9)], "k long, trace array<double>")
    product, v = factors.Product(foot, traces, 2), rng.normal(size=(9, 2))
    assert product.joined == (limit == 0) and product.pixels == len({p for p, _ in np.argwhere(a)} | {4})
    assert np.isclose(product.total(), (a @ b).sum())
    for positive in (False, True):
        w = np.maximum(a @ b @ v, 0) if positive else a @ b @ v
        turned, squares, parts = product.turned(v, positive)
        assert np.allclose(turned, w.T @ a @ b) and np.allclose(squares, w.T @ w)
        assert np.allclose(parts, [(np.maximum(w, 0) ** 2).sum(axis=0), (np.maximum(-w, 0) ** 2).sum(axis=0)])
        image = product.images(v, positive)[0]
        assert limit == 0 or "Join" not in image._jdf.queryExecution().optimizedPlan().toString()
        got = {r["px"]: r["w"] for r in image.collect()}
        assert sorted(got) == np.flatnonzero(a.any(axis=1)).tolist() and all(np.allclose(x, w[p]) for p, x in got.items())
