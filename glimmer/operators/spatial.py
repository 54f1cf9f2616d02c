"""Weights of pixels on the traces of the components that may reach them.

Pixels are grouped by blocks of consecutive numbers, and a block gets each trace that
any of its pixels asks for once, so a trace is sent to as many blocks as its component
touches and not to every pixel.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive pixels that one task solves with the traces they share.
BLOCK = 256


def pixel_weights(pixels: DataFrame, candidates: DataFrame, traces: DataFrame, solve: Callable, background: DataFrame | None = None) -> DataFrame:
    """``px, k, w``: arrays, for every pixel with a candidate that has a trace; k ascending.

    ``solve(y, c, noise)`` gives the weights of one pixel's trace on the rows of ``c``;
    noise is None unless ``pixels`` has it; ``background (px, trace)`` is taken off first.
    """
    block = lambda px: F.floor(F.col(px) / BLOCK)
    pairs = candidates.select("k", "px").distinct().join(traces.select("k"), "k", "left_semi")
    own = pairs.groupBy("px").agg(F.sort_array(F.collect_list("k")).alias("own"))  # a pixel's candidates
    d = pixels.select("px", "trace", *(["noise"] if "noise" in pixels.columns else [])).join(own, "px")
    if background is not None:
        d = d.join(background.select("px", F.col("trace").alias("back")), "px", "left")
    sent = pairs.select(block("px").alias("block"), "k").distinct().join(traces.select("k", "c"), "k")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at = {k: i for i, k in enumerate(right.k.tolist())}
        c = np.stack(right.c.to_numpy()).astype(float) if len(right) else np.zeros((0, 0))
        backs = left.back if "back" in left else [None] * len(left)
        noises = left.noise if "noise" in left else [None] * len(left)
        w = []
        for y, own, back, noise in zip(left.trace, left.own, backs, noises, strict=True):
            y = np.asarray(y, float) if back is None else np.asarray(y, float) - np.asarray(back, float)
            w.append(np.asarray(solve(y, c[[at[k] for k in own]], noise), float))
        return pd.DataFrame({"px": left.px.astype("int64"), "k": pd.Series(left.own.tolist(), dtype=object), "w": pd.Series(w, dtype=object)})

    grouped = d.withColumn("block", block("px")).groupBy("block").cogroup(sent.groupBy("block"))
    return grouped.applyInPandas(run, "px long, k array<long>, w array<double>")


def positive(weights: DataFrame) -> DataFrame:
    """``k, px, w`` > 0 of packed weights."""
    d = weights.select("px", F.explode(F.arrays_zip("k", "w")).alias("x"))
    return d.select(F.col("x.k").alias("k"), "px", F.col("x.w").alias("w")).where("w > 0")


def lasso_path(gram: np.ndarray, b: np.ndarray, non_negative: bool = True, stop: Callable[[float, np.ndarray], bool] | None = None) -> list[tuple[float, np.ndarray]]:
    """(penalty, weights) at the knots of the minimum of w G w / 2 - b w + penalty |w|_1, from the largest penalty on; linear between them.

    Ends at penalty 0, or at the first knot for which ``stop`` holds. Columns that the active ones span wait until one of those leaves.
    """
    n = len(b)
    w, sign, active, waiting, just_left = np.zeros(n), np.zeros(n), [], set(), set()
    force = lambda j: b[j] if non_negative else abs(b[j])
    first = max(range(n), key=force, default=None)
    if first is None or force(first) <= 0:
        return [(0.0, w)]
    level = float(force(first))
    knots, entering = [(level, w.copy())], first
    tiny = 1e-12 * max(level, 1e-300)
    for _ in range(20 * n + 20):
        if entering is not None:
            trial = [*active, entering]
            if np.linalg.matrix_rank(gram[np.ix_(trial, trial)], hermitian=True) < len(trial):
                waiting.add(entering)
            else:
                active.append(entering)
                sign[entering] = 1.0 if non_negative else np.sign(b[entering] - gram[entering] @ w)
        move = np.zeros(n)  # change of the weights as the penalty falls by one
        if active:
            move[active] = np.linalg.solve(gram[np.ix_(active, active)], sign[active])
        pull, turn = b - gram @ w, gram @ move
        best, entering, leaving = level, None, None
        for j in range(n):
            if j in active:
                if move[j] * sign[j] < 0 and (step := -w[j] / move[j]) < best - tiny:
                    best, entering, leaving = max(step, 0.0), None, j
            elif j not in waiting:
                for s in (1.0,) if non_negative else (1.0, -1.0):
                    rate = 1.0 - s * turn[j]
                    gap = level - s * pull[j]
                    if rate > 1e-12 and (step := gap / rate) < best - tiny and not (j in just_left and step <= tiny):
                        best, entering, leaving = max(step, 0.0), j, None
        w = w + best * move
        level = max(level - best, 0.0)
        just_left = set()
        if leaving is not None:
            active.remove(leaving)
            w[leaving], sign[leaving] = 0.0, 0.0
            waiting.clear()
            just_left = {leaving}
        knots.append((level, w.copy()))
        if level <= tiny or stop is not None and stop(level, w):
            return knots
    raise RuntimeError("lasso_path: the steps ended before the path")


def lasso_at_noise(gram: np.ndarray, b: np.ndarray, energy: float, limit: float, non_negative: bool = True) -> tuple[np.ndarray, float, bool]:
    """(weights, penalty, reached) where the squared residual ``energy`` - 2 b w + w G w falls to ``limit`` on the lasso path.

    A limit that even no weights keep gives none; one that no weights reach gives the end of the path, and ``reached`` is false.
    """
    residual = lambda w: energy - 2 * float(b @ w) + float(w @ gram @ w)
    if energy <= limit:
        return np.zeros(len(b)), float(max(b.max(initial=0.0), 0.0) if non_negative else np.abs(b).max(initial=0.0)), True
    knots = lasso_path(gram, b, non_negative, lambda level, w: residual(w) <= limit)
    level, w = knots[-1]
    if residual(w) > limit:
        return w, level, False
    before, last = knots[-2]
    d = w - last  # the residual is a parabola along the last stretch
    p, q, r = float(d @ gram @ d), 2 * float(d @ (gram @ last - b)), residual(last) - limit
    share = 2 * r / (-q + np.sqrt(max(q * q - 4 * p * r, 0.0))) if r > 0 else 0.0
    share = min(max(share, 0.0), 1.0)
    return last + share * d, before + share * (level - before), True


def weights_at_noise(pixels: DataFrame, candidates: DataFrame, traces: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """``px, k, w, penalty, reached``: non-negative weights of least sum whose residual is each pixel's noise (``pixels``: px, trace, noise).

    The residual's limit is noise^2 times the number of frames. Where the least-squares weights leave more, they are taken and ``reached`` is false.
    """

    def solve(y, c, noise):
        w, penalty, reached = lasso_at_noise(c @ c.T, c @ y, float(y @ y), noise**2 * len(y))
        return np.concatenate([w, [penalty, float(reached)]])

    d = pixel_weights(pixels, candidates, traces, solve, background)
    n = F.size("k")
    return d.select("px", "k", F.slice("w", F.lit(1), n).alias("w"), F.get("w", n).alias("penalty"), (F.get("w", n + 1) > 0).alias("reached"))
