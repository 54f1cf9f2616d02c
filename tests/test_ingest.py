"""Frames read and streamed by range, appended stores, conversion, and preprocessing as one step."""

import numpy as np
import pytest
from test_sources import write_tiff

from glimmer.operators import numerics
from glimmer.plans import preprocess
from glimmer.sources import ingest


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    spark.dataSource.register(ingest.FrameSource)


def stored(d):
    return {r.t: np.array(r.pixels).reshape(r.rows, r.columns) for r in d.collect()}


def test_read_by_range(spark, tmp_path):
    frames = np.random.default_rng(1).integers(0, 200, (7, 6, 4)).astype("<u2")
    write_tiff(tmp_path / "a.tif", frames)
    (tmp_path / "a.raw").write_bytes(frames.tobytes() + b"xx")  # a frame that is not whole
    for name in ("a.tif", "a.raw"):
        d = spark.read.format("frames").option("path", str(tmp_path / name)).option("rows", 6).option("columns", 4).option("framesPerTask", 3).load()
        got = stored(d)
        assert sorted(got) == list(range(7)) and all((got[t] == frames[t]).all() for t in got)
        assert d.rdd.getNumPartitions() == 3


def test_a_growing_file_is_appended(spark, tmp_path):
    frames = np.random.default_rng(2).integers(5, 200, (9, 3, 5)).astype("<u2")
    path, store, checkpoint = tmp_path / "a.raw", str(tmp_path / "store"), str(tmp_path / "checkpoint")

    def run():
        stream = spark.readStream.format("frames").option("path", str(path)).option("rows", 3).option("columns", 5).option("framesPerTask", 2).load()
        query = ingest.ingest(stream, store, checkpoint)
        query.awaitTermination(120)
        assert query.exception() is None

    path.write_bytes(frames[:4].tobytes() + frames[4].tobytes()[:7])
    run()
    assert ingest.running_least(spark, store) == (4, frames[:4].min())
    frames[6, 1, 1] = 1
    path.write_bytes(frames.tobytes())
    run()
    got = stored(ingest.stored_frames(spark, store))
    assert sorted(got) == list(range(9)) and all((got[t] == frames[t]).all() for t in got)
    assert ingest.running_least(spark, store) == (9, 1.0)
    ingest.append_frames(ingest.stored_frames(spark, store).where("t < 2"), str(tmp_path / "other"), 0)
    ingest.append_frames(ingest.stored_frames(spark, store).where("t < 2"), str(tmp_path / "other"), 0)  # a batch that comes again
    assert ingest.running_least(spark, str(tmp_path / "other"))[0] == 2


def test_conversion(spark):
    frames = np.random.default_rng(3).random((7, 6, 5))
    d = spark.createDataFrame([("p", t, 6, 5, f.ravel().tolist()) for t, f in enumerate(frames)], "path string, t int, rows int, columns int, pixels array<double>").repartition(3)
    got = stored(ingest.converted(d, 3, 1, 2, 0, 1))
    assert sorted(got) == [0, 1] and all(np.allclose(got[k], frames[3 * k : 3 * k + 3, 1:4, :4].mean(axis=0)) for k in got)
    assert stored(ingest.converted(d, 1, 3, 4))[2].shape == (0, 5)
    assert ingest.converted(d.limit(0), 2).count() == 0


def test_preprocessing(spark):
    rng = np.random.default_rng(4)
    y = np.zeros((40, 300))
    s = (rng.random((40, 300)) < 0.05).astype(float)
    for t in range(2, 300):
        y[:, t] = 1.5 * y[:, t - 1] - 0.56 * y[:, t - 2] + s[:, t]
    y += 0.05 * rng.normal(size=y.shape)
    y[20:] = 0.05 * rng.normal(size=(20, 300))
    y[3, 50:300] = 15  # saturated
    rows = [(i, i // 8, i % 8, [float(v) for v in x]) for i, x in enumerate(y)]
    rows[5][3][10] = None
    rows[6][3][0] = None
    rows.append((40, 5, 0, [None] * 300))
    d, g = preprocess.preprocessed(spark.createDataFrame(rows, "px long, r int, c int, trace array<double>").repartition(3))
    got = {r.px: r for r in d.collect()}
    assert sorted(got) == list(range(40)) and [got[i].n_missing for i in (4, 5, 6)] == [0, 1, 1]
    assert got[5].trace[10] == pytest.approx((y[5, 9] + y[5, 11]) / 2) and got[6].trace[0] == pytest.approx(2 * y[6, 1] - y[6, 2])
    assert not got[3].unsaturated and got[7].unsaturated
    assert got[9].noise == pytest.approx(numerics.noise_level(y[9]))
    assert len({got[i].active for i in range(20, 40)}) == 1 and got[25].active != got[9].active
    few = spark.createDataFrame([r for r in rows if r[0] in (9, 10, 11)], "px long, r int, c int, trace array<double>")
    _, own = preprocess.preprocessed(few, cluster=False)
    want_rows, want = [], []
    for i in (9, 10, 11):
        x = y[i] - y[i].mean()
        v = np.array([x[k:] @ x[: 300 - k] / 300 for k in range(8)])
        v[0] -= numerics.noise_level(y[i]) ** 2
        want_rows += [[v[abs(k - 1)], v[abs(k - 2)]] for k in range(1, 8)]
        want += list(v[1:8])
    assert np.allclose(own, np.linalg.lstsq(np.array(want_rows), np.array(want), rcond=None)[0], atol=1e-6)
    empty = few.limit(0)
    assert preprocess.preprocessed(empty, cluster=False)[1] == []
