"""Stacks written here and read back."""

import struct

import numpy as np
import pytest

from glimmer.sources import sinks, stacks


def write_tiff(path, frames, order="<"):
    kind = {"u": 1, "i": 2, "f": 3}[frames.dtype.kind]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))
    for t, frame in enumerate(frames):
        data = frame.astype(frame.dtype.newbyteorder(order)).tobytes()
        half = len(data) // 2 // frame.itemsize * frame.itemsize
        at = len(out)
        strips = at + 2 + 12 * 7 + 4
        body = strips + 16
        tags = [(256, 4, 1, frame.shape[1]), (257, 4, 1, frame.shape[0]), (258, 3, 1, frame.itemsize * 8), (259, 3, 1, 1), (273, 4, 2, strips), (279, 4, 2, strips + 8), (339, 3, 1, kind)]
        out += struct.pack(order + "H", len(tags))
        for tag, field, n, value in tags:
            out += struct.pack(order + "HHI", tag, field, n) + (struct.pack(order + "HH", value, 0) if field == 3 else struct.pack(order + "I", value))
        following = body + len(data)
        out += struct.pack(order + "I", following if t + 1 < len(frames) else 0)
        out += struct.pack(order + "IIII", body, body + half, half, len(data) - half) + data
    path.write_bytes(out)


@pytest.mark.parametrize(("dtype", "order"), [("u1", "<"), ("u2", ">"), ("f4", "<"), ("f8", ">")])
def test_tiff(spark, tmp_path, dtype, order):
    frames = np.random.default_rng(1).integers(0, 200, (5, 6, 4)).astype(dtype)
    write_tiff(tmp_path / "a.tif", frames, order)
    plan = stacks.tiff_plan(spark, [str(tmp_path / "a.tif")])
    got = {r["t"]: np.array(r["pixels"]).reshape(r["rows"], r["columns"]) for r in stacks.read_frames(plan.where("t between 1 and 3"), 2).collect()}
    assert sorted(got) == [1, 2, 3] and all((got[t] == frames[t]).all() for t in got)


def test_raw_and_movie(spark, tmp_path):
    frames = np.random.default_rng(2).integers(0, 9999, (4, 3, 5)).astype("<u2")
    (tmp_path / "a.raw").write_bytes(frames.tobytes())
    d = stacks.movie(stacks.read_frames(stacks.raw_plan(spark, str(tmp_path / "a.raw"), 3, 5, 4), 2)).collect()
    assert len(d) == 60 and all(frames[r["t"], r["r"], r["c"]] == r["y"] and r["px"] == r["r"] + 3 * r["c"] for r in d)


def test_concatenated(spark, tmp_path):
    for name, n in (("a", 2), ("b", 3)):
        write_tiff(tmp_path / f"{name}.tif", np.full((n, 2, 2), n, "u1"))
    plan = stacks.tiff_plan(spark, [str(tmp_path / f"{n}.tif") for n in "ba"])
    got = sorted((r["t"], r["pixels"][0]) for r in stacks.concatenated(stacks.read_frames(plan, 2)).collect())
    assert got == [(0, 2.0), (1, 2.0), (2, 3.0), (3, 3.0), (4, 3.0)]


def write_big_tiff(path, frames):
    out = bytearray(b"II" + struct.pack("<HHHQ", 43, 8, 0, 16))
    for t, frame in enumerate(frames):
        data, at = frame.tobytes(), len(out)
        tags = [(256, 4, 1, frame.shape[1]), (257, 4, 1, frame.shape[0]), (258, 3, 1, frame.itemsize * 8), (273, 16, 1, at + 8 + 20 * 5 + 8), (279, 16, 1, len(data))]
        out += struct.pack("<Q", len(tags))
        for tag, field, n, value in tags:
            out += struct.pack("<HHQQ", tag, field, n, value)
        following = len(out) + 8 + len(data)
        out += struct.pack("<Q", following if t + 1 < len(frames) else 0) + data
    path.write_bytes(out)


def test_big_tiff_and_dispatch(spark, tmp_path):
    frames = np.random.default_rng(3).integers(0, 60_000, (3, 4, 5)).astype("<u2")
    (tmp_path / "deep").mkdir()
    write_big_tiff(tmp_path / "deep" / "b.btf", frames)
    write_tiff(tmp_path / "a.tif", frames[:1])
    (tmp_path / "c.raw").write_bytes(frames.tobytes())
    found = stacks.listed(spark, str(tmp_path), "*.{tif,btf}")
    assert [p.rsplit("/", 1)[1] for p in found] == ["a.tif", "b.btf"]
    got = {r["t"]: np.array(r["pixels"]).reshape(4, 5) for r in stacks.read_stack(spark, found, 2).collect()}
    assert sorted(got) == [0, 1, 2, 3] and (got[0] == frames[0]).all() and (got[3] == frames[2]).all()
    raw = stacks.read_stack(spark, str(tmp_path / "c.raw"), 2, 4, 5, 3).collect()
    assert len(raw) == 3
    with pytest.raises(ValueError):
        stacks.read_stack(spark, str(tmp_path / "c.raw"), 2)


def test_packed_store(spark, tmp_path):
    """Frames become pixels, are stored, and come back whole or by patch."""
    frames = np.random.default_rng(4).integers(0, 999, (6, 40, 35)).astype("<u2")
    (tmp_path / "a.raw").write_bytes(frames.tobytes())
    d = stacks.packed(stacks.read_frames(stacks.raw_plan(spark, str(tmp_path / "a.raw"), 40, 35, 6), 2))
    folder = str(tmp_path / "store")
    sinks.save_movie(d, folder, 3)
    got = sinks.load_movie(spark, folder).collect()
    assert len(got) == 1400 and all(r["px"] == r["r"] * 35 + r["c"] and r["trace"] == frames[:, r["r"], r["c"]].tolist() for r in got)
    part = sinks.load_patch(spark, folder, 3, 6, 30, 34).collect()
    assert {(r["r"], r["c"]) for r in part} == {(r, c) for r in range(3, 7) for c in range(30, 35)}
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.save_movie(d, folder, 3)
    results = {"traces": d.select("px", "trace"), "grid": d.select("px", "r", "c")}
    sinks.save_results(results, str(tmp_path / "results"))
    sinks.save_results(results, str(tmp_path / "results"), overwrite=True)
    assert {k: x.count() for k, x in sinks.load_results(spark, str(tmp_path / "results"), *results).items()} == {"traces": 1400, "grid": 1400}
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.save_results(results, str(tmp_path / "results"))
