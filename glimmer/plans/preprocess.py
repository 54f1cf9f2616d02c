"""Preprocessing of a movie as one step: missing samples, saturation, noise, active pixels and a common autoregression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import dot, mean
from ..operators import images, numerics, quality
from .lineage import cut


def preprocessed(pixels: DataFrame, order: int = 2, lags: int = 5, cluster: bool = True) -> tuple[DataFrame, list[float]]:
    """(``px, r, c, trace, noise, unsaturated, active, n_missing``, g) of packed ``pixels (px, r, c, trace)``.

    Null samples are interpolated in their pixel first (one without any known sample is
    dropped). ``noise`` is the level from the upper half of each spectrum, ``active`` tells
    the pixels of the cluster with less power there (all without ``cluster``). ``g`` are the coefficients of
    one autoregression of ``order`` for all pixels, by least squares over their stacked covariances, of which ``lags`` more are used,
    each pixel's noise taken off lag 0; without pixels or variance it is empty.
    """
    missing = F.size(F.filter("trace", lambda x: x.isNull()))
    d = pixels.select("px", "r", "c", "trace", missing.alias("n_missing"))
    whole = d.where("n_missing = 0")
    gaps = images.interpolated(d.where("n_missing > 0").select("px", F.posexplode_outer("trace").alias("t", "y")).where("t is not null"))
    filled = gaps.groupBy("px").agg(F.sort_array(F.collect_list(F.struct("t", "y"))).alias("s")).select("px", F.col("s.y").alias("filled"))
    mended = d.where("n_missing > 0").join(filled, "px").where(F.exists("filled", lambda x: x.isNotNull())).select("px", "r", "c", F.col("filled").alias("trace"), "n_missing")
    d = cut(whole.union(mended))
    noise = numerics.map_traces(d, lambda y: {"noise": numerics.noise_level(y)}, "noise double", "px", "trace")
    d = d.join(noise, "px").join(images.unsaturated(d).select("px", F.lit(True).alias("unsaturated")), "px", "left")
    if cluster:
        d = d.join(quality.active_pixels(d.select("px", "r", "c", "trace")).select("px", "active"), "px", "left")
    else:
        d = d.withColumn("active", F.lit(True))
    d = cut(d.select("px", "r", "c", "trace", "noise", F.coalesce("unsaturated", F.lit(False)).alias("unsaturated"), F.coalesce("active", F.lit(False)).alias("active"), "n_missing"))
    return d, common_autoregression(d.select("trace", "noise"), order, lags)


def common_autoregression(traces: DataFrame, order: int, lags: int) -> list[float]:
    """Coefficients of one autoregression for all ``traces (trace, noise)``: each pixel adds its normal equations, which are summed."""
    d = traces.where(F.size("trace") > order + lags).withColumn("m", mean(F.col("trace"))).withColumn("x", F.transform("trace", lambda x: x - F.col("m")))
    n = F.size("x")
    v = F.transform(F.sequence(F.lit(0), F.lit(order + lags)), lambda i: dot(F.slice("x", F.lit(1), n - i), F.slice("x", i + 1, n - i)) / n)
    d = d.select(v.alias("v"), (F.col("noise") * F.col("noise")).alias("s"))
    cov = [F.col("v")[i] - (F.col("s") if i == 0 else 0.0) for i in range(order + lags + 1)]
    rows = [([cov[abs(i - j)] for j in range(1, order + 1)], cov[i]) for i in range(1, order + lags + 1)]
    pairs = {(a, b): sum((r[0][a] * r[0][b] for r in rows), F.lit(0.0)) for a in range(order) for b in range(a, order)}
    right = [sum((r[0][a] * r[1] for r in rows), F.lit(0.0)) for a in range(order)]
    found = d.agg(*(F.sum(e).alias(f"p{a}_{b}") for (a, b), e in pairs.items()), *(F.sum(e).alias(f"q{a}") for a, e in enumerate(right))).first()
    if found[0] is None or not found[0]:
        return []
    gram = np.array([[found[f"p{min(a, b)}_{max(a, b)}"] for b in range(order)] for a in range(order)])
    return np.linalg.lstsq(gram, np.array([found[f"q{a}"] for a in range(order)]), rcond=None)[0].tolist()
