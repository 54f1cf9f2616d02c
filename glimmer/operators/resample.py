"""Cubic resampling of movies and traces, low-passed where it shrinks them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numerics import map_traces

#: Source pixels on each side of the block that one task resamples, without its margin.
SIDE = 32


def cubic(x: np.ndarray) -> np.ndarray:
    """Cubic convolution kernel of parameter -1/2 (Keys 1981)."""
    a = np.abs(x)
    return np.where(a <= 1, (1.5 * a - 2.5) * a * a + 1, np.where(a <= 2, ((-0.5 * a + 2.5) * a - 4) * a + 2, 0.0))


def resampling(length: int, size: int, scale: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights), each ``size`` by taps: what the samples of an axis of ``length`` contribute to one of ``size``.

    Weights add up to one; places beyond an end are reflected about it. Where the axis
    shrinks the kernel is stretched by as much, so that nothing is aliased.
    """
    scale = size / length if scale is None else scale
    stretch = max(1.0, 1 / scale)
    at = (np.arange(size) + 0.5) / scale - 0.5
    places = np.floor(at - 2 * stretch).astype(int)[:, None] + np.arange(math.ceil(4 * stretch) + 2)
    weights = cubic((at[:, None] - places) / stretch)
    weights /= weights.sum(axis=1, keepdims=True)
    folded = places % (2 * length)
    return np.where(folded < length, folded, 2 * length - 1 - folded), weights


def resized(pixels: DataFrame, rows: int, columns: int, scale: float) -> DataFrame:
    """``r, c, trace`` of a movie of ``rows`` x ``columns`` (packed ``r, c, trace``) at ``scale``; sides are rounded up.

    A source pixel goes to the blocks of target pixels it acts on, most often one; a
    task resamples a block of all frames, axis after axis. A pixel without a row or a
    trace counts as zero; an empty movie has no rows.
    """
    out = math.ceil(rows * scale), math.ceil(columns * scale)
    side, reach = max(1, round(SIDE * scale)), 2 * max(1.0, 1 / scale)
    taps = [resampling(n, m, scale) for n, m in zip((rows, columns), out, strict=True)]

    def blocks(axis: str, size: int):
        first = F.greatest(F.ceil((F.col(axis) - reach + 0.5) * scale - 0.5), F.lit(0))
        last = F.least(F.floor((F.col(axis) + reach + 0.5) * scale - 0.5), F.lit(size - 1))
        return F.explode_outer(F.when(first <= last, F.sequence(F.floor(first / side).cast("int"), F.floor(last / side).cast("int"))))

    def run(key, table):
        r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
        y = table.column("trace").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(r), -1)
        r0, c0 = r.min(), c.min()
        cube = np.zeros((r.max() - r0 + 1, c.max() - c0 + 1, y.shape[1]))
        cube[r - r0, c - c0] = y
        targets = []
        for axis, (low, (places, weights)) in enumerate(zip((r0, c0), taps, strict=True)):
            own = np.arange(key[axis].as_py() * side, min((key[axis].as_py() + 1) * side, out[axis]))
            part = np.zeros((len(own), cube.shape[axis]))
            inside = (places[own] >= low) & (places[own] < low + cube.shape[axis])
            np.add.at(part, (np.nonzero(inside)[0], places[own][inside] - low), weights[own][inside])
            cube = np.moveaxis(np.tensordot(part, cube, (1, axis)), 0, axis)
            targets.append(own)
        count = len(targets[0]) * len(targets[1])
        lists = pa.ListArray.from_arrays(np.arange(count + 1, dtype=np.int32) * y.shape[1], cube.ravel())
        return pa.table({"r": np.repeat(targets[0], len(targets[1])).astype(np.int32), "c": np.tile(targets[1], len(targets[0])).astype(np.int32), "trace": lists})

    d = pixels.where("trace is not null").select(F.col("r").cast("int"), F.col("c").cast("int"), "trace")
    d = d.withColumn("br", blocks("r", out[0])).withColumn("bc", blocks("c", out[1])).where("br is not null and bc is not null")
    return d.groupBy("br", "bc").applyInArrow(run, "r int, c int, trace array<double>")


def resized_traces(traces: DataFrame, frames: int, floor: float | None = None, quiet: float | None = None) -> DataFrame:
    """``k, c``: traces at ``frames`` frames.

    ``floor``: values below it are raised to it (the cubic undershoots beside spikes);
    ``quiet``: values smaller than it in size become zero. An empty trace stays empty.
    """

    def one(y: np.ndarray) -> dict:
        if not len(y):
            return {"c": []}
        places, weights = resampling(len(y), frames)
        x = (weights * y[places]).sum(axis=1)
        x = x if floor is None else np.maximum(x, floor)
        x = x if quiet is None else np.where(np.abs(x) < quiet, 0.0, x)
        return {"c": x.tolist()}

    return map_traces(traces, one, "c array<double>")
