"""Masks, crops, activity and residuals of components (``k, px, w`` and ``k, c``)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import correlation, dot, mean, total
from ..plans.lineage import ranked_by
from .linalg import binary_edges, centers, reconstruction
from .numerics import map_traces


def energy_mask(foot: DataFrame, share: float) -> DataFrame:
    """``k, px, w`` of the strongest pixels that hold ``share`` of a footprint's energy; equal weights by pixel."""
    w = Window.partitionBy("k").orderBy("w", "px").rowsBetween(Window.unboundedPreceding, 0)
    d = foot.withColumn("below", F.sum(F.col("w") * F.col("w")).over(w)).withColumn("all", F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("k")))
    return d.where(F.col("below") > (1 - share) * F.col("all")).select("k", "px", "w")


def on_active_pixels(foot: DataFrame, active: DataFrame, least: float) -> DataFrame:
    """``k, keep``: whether a footprint keeps ``least`` of its norm on the ``active (px)`` pixels."""
    d = foot.join(active.select("px", F.lit(True).alias("on")).distinct(), "px", "left")
    square = F.col("w") * F.col("w")
    return d.groupBy("k").agg((F.sum(F.when(F.col("on"), square).otherwise(0.0)) >= least * least * F.sum(square)).alias("keep"))


def event_frames(traces: DataFrame, level: Column, least: int) -> DataFrame:
    """``k, n``: frames above ``level`` that lie in runs of at least ``least`` such frames; row by row."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("n"))

    def step(s, above):
        run = F.when(above, s["run"] + 1).otherwise(0)
        gained = F.when(run == least, least).when(run > least, 1).otherwise(0)
        return F.struct(run.alias("run"), (s["n"] + gained).alias("n"))

    d = traces.withColumn("level", level)
    return d.select("k", F.aggregate(F.transform("c", lambda x: x > F.col("level")), start, step, lambda s: s["n"]).alias("n"))


def ranked_by_events(events: DataFrame) -> DataFrame:
    """``k, n, rank``: most active first, ties by k."""
    return ranked_by(events, F.desc("n"), "k")


def stacked_ar2(traces: DataFrame, lags: int, noise_var: float) -> DataFrame:
    """``g1, g2``: one pair of coefficients for all traces, by least squares over their stacked covariance equations.

    Equation l of a trace: v(l + 1) = g1 v(l) + g2 v(|l - 1|), the noise variance
    taken off lag 0. Five sums a row, then one aggregation.
    """
    d = traces.withColumn("m", mean(F.col("c"))).withColumn("c", F.transform("c", lambda x: x - F.col("m")))
    n = F.size("c")
    d = d.select(F.transform(F.sequence(F.lit(0), F.lit(lags)), lambda i: dot(F.slice("c", 1, n - i), F.slice("c", i + 1, n - i)) / n).alias("v"))
    v = [F.get("v", i) for i in range(lags + 1)]
    rows = [(v[abs(i)] - (noise_var if i == 0 else 0.0), v[abs(i - 1)] - (noise_var if i == 1 else 0.0), v[i + 1]) for i in range(lags)]
    sums = {"aa": (0, 0), "ab": (0, 1), "bb": (1, 1), "at": (0, 2), "bt": (1, 2)}
    s = d.agg(*(F.sum(sum((r[i] * r[j] for r in rows[1:]), rows[0][i] * rows[0][j])).alias(name) for name, (i, j) in sums.items()))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    return s.select(F.try_divide(F.col("at") * F.col("bb") - F.col("bt") * F.col("ab"), det).alias("g1"), F.try_divide(F.col("bt") * F.col("aa") - F.col("at") * F.col("ab"), det).alias("g2"))


def crops(foot: DataFrame, rows: int, half: int) -> DataFrame:
    """``k, dr, dc, w``: unit-norm footprints around their rounded centres; what is not listed is zero."""
    middle = centers(foot, rows).select("k", F.round("r").alias("r"), F.round("c").alias("c"))
    norm = foot.groupBy("k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    d = foot.join(middle.join(norm, "k"), "k")
    d = d.select("k", (F.col("px") % rows - F.col("r")).cast("int").alias("dr"), (F.floor(F.col("px") / rows) - F.col("c")).cast("int").alias("dc"), (F.col("w") / F.col("norm")).alias("w"))
    return d.where((F.abs("dr") <= half) & (F.abs("dc") <= half))


def outlines(foot: DataFrame, rows: int) -> DataFrame:
    """``k, json``: one JSON object a footprint: id, pixels, bounding box (first and last row, first and last column)."""
    r, c = (F.col("px") % rows).cast("int"), F.floor(F.col("px") / rows).cast("int")
    d = foot.groupBy("k").agg(F.count("*").alias("pixels"), F.array(F.min(r), F.max(r), F.min(c), F.max(c)).alias("bbox"))
    return d.select("k", F.to_json(F.struct(F.col("k").alias("id"), "pixels", "bbox")).alias("json"))


def rolling_energy(pixels: DataFrame, window: int) -> DataFrame:
    """``px, v``: largest causal moving mean of squares; the frames before the first count as zero."""

    def one(y: np.ndarray) -> dict:
        sums = np.convolve(y * y, np.ones(window))[: len(y)]
        return {"v": float(sums.max()) / window if len(y) else None}

    return map_traces(pixels, one, "v double", "px", "trace")


def rises(traces: DataFrame, least: float) -> DataFrame:
    """``k, c``: frame-to-frame rises, those under ``least`` set to zero."""
    n = F.size("c") - 1
    return traces.select("k", F.zip_with(F.slice("c", 2, n), F.slice("c", 1, n), lambda x, y: F.when(x - y >= least, x - y).otherwise(0.0)).alias("c"))


def triple_edges(foot: DataFrame, traces: DataFrame, spikes: DataFrame, overlap: float, rho: float, spike_rho: float) -> DataFrame:
    """``k1 < k2, rho, spike_rho`` of pairs whose masks, traces and spikes all agree by more than their thresholds.

    Overlap comes first, so only pairs that share pixels are correlated; constant traces agree with none.
    """
    both = traces.join(spikes.select("k", F.col("c").alias("s")), "k")
    d = binary_edges(foot, overlap).select("k1", "k2")
    for i in "12":
        d = d.join(both.select(F.col("k").alias(f"k{i}"), F.col("c").alias(f"c{i}"), F.col("s").alias(f"s{i}")), f"k{i}")
    d = d.select("k1", "k2", correlation(F.col("c1"), F.col("c2")).alias("rho"), correlation(F.col("s1"), F.col("s2")).alias("spike_rho"))
    return d.where((F.col("rho") > rho) & (F.col("spike_rho") > spike_rho))


def residual_movie(foot: DataFrame, traces: DataFrame, pixels: DataFrame) -> DataFrame:
    """``px, trace``: packed pixels less the components. Footprints are cut to the movie's pixels before they meet the traces."""
    model = reconstruction(foot.join(pixels.select("px"), "px", "left_semi"), traces).select("px", F.col("trace").alias("x"))
    left = F.when(F.col("x").isNull(), F.col("trace")).otherwise(F.zip_with("trace", "x", lambda y, m: y - m))
    return pixels.select("px", "trace").join(model, "px", "left").select("px", left.alias("trace"))


def poles_of_times(grid: DataFrame, dt: float) -> DataFrame:
    """``tau_d, tau_r, d, r``: discrete poles of decay and rise times at frame length ``dt``."""
    return grid.select("tau_d", "tau_r", F.exp(-dt / F.col("tau_d")).alias("d"), F.exp(-dt / F.col("tau_r")).alias("r"))
