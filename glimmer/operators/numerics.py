"""Per-trace and per-pixel numerics on numpy: what has no closed relational form.

All functions take and return arrays of one trace (or one pixel), and are applied
where the row lies by ``map_traces``, or to the pixels of one patch.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

NORMAL = NormalDist()


def map_traces(traces: DataFrame, f: Callable, schema: str, key: str = "k", values: str = "c", many: bool = False) -> DataFrame:
    """``f`` on every trace, in Arrow batches and without a shuffle; ``schema`` lists f's fields after the key. With ``many`` f takes and returns lists."""
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(frames):
        for pdf in frames:
            own = [np.asarray(x, float) for x in pdf[values]]
            rows = f(own) if many else [f(y) for y in own]
            yield pd.DataFrame({key: pdf[key].to_numpy(), **{c: [r[c] for r in rows] for c in columns}})

    return traces.select(key, values).mapInPandas(run, f"{key} long, {schema}")


def power_spectrum(y: np.ndarray, frames: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, one-sided power) of at most ``frames`` samples."""
    y = y[:frames]
    n = len(y)
    p = np.abs(np.fft.rfft(y)) ** 2 / n
    p[1 : n // 2 + 1 - (n % 2 == 0)] *= 2
    return np.fft.rfftfreq(n), p


def noise_level(y: np.ndarray, low: float = 0.25, high: float = 0.5, how: str = "mean") -> float:
    """Standard deviation of the noise from the power between ``low`` (excluded) and ``high``."""
    f, p = power_spectrum(y)
    own = p[(f > low) & (f <= high)] / 2
    if how == "mean":
        return float(np.sqrt(own.mean()))
    if how == "median":
        return float(np.sqrt(np.median(own)))
    return float(np.sqrt(np.exp(np.log(own + 1e-300).mean())))


def half_sample_mode(x: np.ndarray) -> float:
    """Mode by taking, again and again, the half of the sorted samples with the least range."""
    x = np.sort(x)
    while len(x) > 3:
        half = math.ceil(len(x) / 2)
        width = x[half - 1 :] - x[: len(x) - half + 1]
        at = int(width.argmin())
        x = x[at : at + half]
    if len(x) == 3:
        a, b = x[1] - x[0], x[2] - x[1]
        x = x[:2] if a < b else x[1:] if b < a else x[1:2]
    return float(x.mean())


def event_fitness(y: np.ndarray, n: int = 12) -> dict:
    """Least sum over ``n`` frames of the log tail probability of the trace above its mode."""
    mode = max(0.0, half_sample_mode(y))
    below = y[y < mode]
    sd = float(np.sqrt(((below - mode) ** 2).mean())) if len(below) else 0.0
    z = (y - mode) / (3 * sd) if sd else np.zeros(len(y))
    tail = np.array([math.log(max(0.5 * math.erfc(v / math.sqrt(2)), 1e-300)) for v in z])
    sums = np.concatenate([[0.0], np.cumsum(np.concatenate([np.zeros(math.ceil(n / 2) - 1), tail, np.zeros(n // 2)]))])
    return {"fitness": float((sums[n:] - sums[:-n]).min()), "mode": mode, "sd": sd}


def welch_noise(y: np.ndarray, low: float = 0.25, high: float = 0.5, how: str = "logmexp") -> float:
    """Noise deviation from Welch's spectrum: eight half-overlapping segments under a Hamming window, ``low`` and ``high`` included."""
    n = len(y)
    size = max(2, int(n // 4.5))
    taper = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(size) / (size - 1))
    length = max(256, 1 << (size - 1).bit_length())
    parts = [y[a : a + size] * taper for a in range(0, n - size + 1, size - size // 2)]
    p = np.mean([np.abs(np.fft.rfft(x, length)) ** 2 for x in parts], axis=0) / (taper @ taper)
    p[1:-1] *= 2
    f = np.fft.rfftfreq(length)
    own = p[(f >= low) & (f <= high)] / 2
    return float(np.sqrt({"mean": np.mean, "median": np.median, "logmexp": lambda x: np.exp(np.log(x + 1e-300).mean())}[how](own)))


def _cosines(x: np.ndarray) -> np.ndarray:
    """Cosine transform: sum of x_j cos(pi k (j + 1/2) / n), doubled but for the first."""
    n = len(x)
    spectrum = np.fft.fft(np.concatenate([x[::2], x[1::2][::-1]]))
    out = 2 * (np.exp(-1j * np.pi * np.arange(n) / (2 * n)) * spectrum).real
    out[0] /= 2
    return out


def _from_cosines(a: np.ndarray) -> np.ndarray:
    """Its inverse times the number of values: a density on the unit interval."""
    n = len(a)
    spectrum = np.exp(1j * np.pi * np.arange(n) / (2 * n)) * a * np.where(np.arange(n), 0.5, 1.0)
    return np.fft.irfft(np.concatenate([spectrum, [0], np.conj(spectrum[1:][::-1])])[: n + 1], 2 * n)[:n] * 2 * n


def diffusion_density(y: np.ndarray, points: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grid, density, distribution) by diffusion with the plug-in bandwidth that solves t = xi gamma(t) over seven stages (Botev, Grotowski and Kroese 2010).

    The grid reaches half the data's range beyond both ends. Constant data are a point mass.
    """
    low, high = float(y.min()), float(y.max())
    spread = high - low
    if spread <= 0:
        return np.array([low]), np.array([1.0]), np.array([1.0])
    grid = np.linspace(low - spread / 2, high + spread / 2, points)
    reach, n = grid[-1] - grid[0], len(np.unique(y))
    share = np.bincount(np.minimum(np.searchsorted(grid, y, "right") - 1, points - 1), minlength=points) / len(y)
    a = _cosines(share)
    k, power = np.arange(1, points, dtype=float) ** 2, (a[1:] / 2) ** 2
    logs = np.log(k)

    def roughness(order: int, t: float) -> float:
        m = min(len(k), int(math.sqrt(800 / (math.pi**2 * t))) + 1)  # later terms vanish
        return 2 * math.pi ** (2 * order) * float(np.exp(order * logs[:m] - k[:m] * (math.pi**2 * t)) @ power[:m])

    def excess(t: float) -> float:
        f = roughness(7, t)
        for s in range(6, 1, -1):
            odd = math.prod(range(1, 2 * s, 2)) / math.sqrt(2 * math.pi)
            f = roughness(s, (2 * (1 + 0.5 ** (s + 0.5)) / 3 * odd / n / f) ** (2 / (3 + 2 * s))) if f > 0 else 0.0
        return t - (2 * n * math.sqrt(math.pi) * f) ** (-0.4) if f > 0 else t - 1.0

    t = _least_root(excess, n)
    density = np.maximum(_from_cosines(a * np.exp(-np.append(0.0, k) * math.pi**2 * t / 2)) / reach, 0.0)
    f = 2 * math.pi**2 * float((k * power * np.exp(-k * math.pi**2 * t)).sum())
    t_cdf = (math.sqrt(math.pi) * f * n) ** (-2 / 3)
    cdf = np.cumsum(_from_cosines(a * np.exp(-np.append(0.0, k) * math.pi**2 * t_cdf / 2))) / points
    return grid, density, cdf


def _least_root(f: Callable[[float], float], n: int) -> float:
    """Least t in (0, 0.1] at which ``f`` turns positive, by steps that widen and then bisection; (0.28 n^-0.4)^2 where there is none."""
    a, b = 0.0, 1e-12 + 0.01 * (min(max(n, 50), 1050) - 50) / 1000
    while f(b) < 0:
        if b >= 0.1:
            return (0.28 * n**-0.4) ** 2
        a, b = b, min(2 * b, 0.1)
    for _ in range(50):
        mid = (a + b) / 2
        a, b = (mid, b) if f(mid) < 0 else (a, mid)
    return b


def percentile_levels(y: np.ndarray, window: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(mode, share at or below it) of the diffusion density of each segment; a last segment under two thirds of a window joins the one before."""
    starts = list(range(0, len(y), shift))
    ends = [*range(window, len(y) + 1, shift), len(y)]
    parts = list(zip(starts, ends, strict=False))
    if len(parts) > 1 and parts[-1][1] - parts[-1][0] < 2 * window / 3:
        parts[-2:] = [(parts[-2][0], parts[-1][1])]
    modes, shares = [], []
    for a, b in parts:
        grid, density, cdf = diffusion_density(y[a:b])
        at = int(density.argmax())
        modes.append(grid[at])
        shares.append(min(max(float(cdf[at]), 0.0), 1.0))
    return np.array(modes), np.array(shares)


def kde_mode(y: np.ndarray) -> dict:
    """Mode of the whole trace's diffusion density, and the share of the density at or below it."""
    mode, level = percentile_levels(y, len(y), len(y))
    return {"mode": float(mode[0]), "level": float(level[0])}


def ar1_pools(y: list[float], g: float, lam: float, smin: float, power: list[float]) -> tuple[list[float], list[float], list[int]]:
    """(sums, weights, lengths) of the pools of an AR(1) trace in order, sum / weight being a pool's first value; ``power``: g to 0, 1, ...."""
    sums, weights, lengths, first = [], [], [], []
    last, off = len(y) - 1, lam * (1 - g)
    for t, x in enumerate(y):
        v = own = x - (off if t < last else lam)
        w, k = 1.0, 1
        while first:
            f, before = power[lengths[-1]], first[-1]
            if not own < (before if before > 0.0 else 0.0) * f + smin:
                break
            first.pop()
            v, w, k = sums.pop() + v * f, weights.pop() + w * f * f, lengths.pop() + k
            own = v / w
        sums.append(v)
        weights.append(w)
        lengths.append(k)
        first.append(own)
    return sums, weights, lengths


def oasis_ar1(y: np.ndarray, g: float, lam: float = 0.0, smin: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(c, s) of the sparse non-negative deconvolution of an AR(1) trace by merging pools of samples."""
    g, c = float(g), []
    power = [g**k for k in range(len(y) + 1)]
    for v, w, k in zip(*ar1_pools(np.asarray(y, float).tolist(), g, float(lam), float(smin), power), strict=True):
        first = max(0.0, v / w)
        c += [first * f for f in power[:k]]
    c = np.array(c, float)
    s = c.copy()
    s[1:] -= g * c[:-1]
    s[np.abs(s) < 1e-12] = 0.0
    s[:1] = 0.0
    return c, s


def ar1_coefficient(y: np.ndarray, noise: float) -> float:
    """Lag-one decay from the autocovariance less the noise variance, held inside (0, 1)."""
    x = y - y.mean()
    a, b = (x @ x) / len(x) - noise**2, (x[1:] @ x[:-1]) / len(x)
    return float(min(max(b / a, 0.05), 0.98)) if a > 0 else 0.95


def constrained_ar1(y: np.ndarray, g: float, noise: float, steps: int = 30) -> tuple[np.ndarray, np.ndarray, float]:
    """(c, s, penalty): the largest penalty whose residual stays within the noise.

    While the pools stay as they are, the residual is a square in the penalty: its root is tried next, and is the result
    once it has the pools that it came from. A bracket keeps the roots in; it is halved where they do not settle, to 2^-``steps`` of its width.
    """
    y, g = np.asarray(y, float), float(g)
    limit, energy, values, power = noise**2 * len(y), float(y @ y), y.tolist(), [g**k for k in range(len(y) + 1)]

    def tried(lam: float) -> tuple[float, float | None, list[int]]:
        """(residual, penalty at which these pools meet the limit, lengths of the pools, negative where they are zero)."""
        part, pull, left, shape = 0.0, 0.0, len(values), []
        for v, w, k in zip(*ar1_pools(values, g, lam, 0.0, power), strict=True):
            left -= k
            if v > 0.0:
                unit = 1.0 - power[k] if left else 1.0  # what a penalty of one takes off the sum
                part += (v + lam * unit) ** 2 / w
                pull += unit * unit / w
            shape.append(k if v > 0.0 else -k)
        rest = limit - energy + part
        return lam * lam * pull - part + energy, math.sqrt(rest / pull) if pull and rest >= 0 else None, shape

    rest, root, shape = tried(0.0)
    low, high, tries = 0.0, math.inf, 0
    if not rest <= limit:
        return *oasis_ar1(y, g), 0.0
    if energy <= limit:  # even no spikes at all do: no penalty is too large
        low = 2.0**20
    while energy > limit and (high == math.inf or high - low > 0.5**steps * high):
        tries += 1
        exact = root is not None and low < root < high and tries % 4
        lam = root if exact else (low + high) / 2 if high < math.inf else max(1.0, 4 * low)
        rest, root, own = tried(lam)
        if exact and own == shape:
            low = lam
            break
        low, high, shape = (lam, high, own) if rest <= limit else (low, lam, own)
    return *oasis_ar1(y, g, low), low


def foopsi_ar1(y: np.ndarray, g: float, lam: float = 0.0, base: float | None = None, steps: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """(c, s, baseline): penalised fit; with ``base`` None the baseline is fitted too.

    At the best baseline the mean of what is left is zero; that mean falls as the
    baseline rises, as the joint problem is convex, so the baseline is bisected.
    """
    if base is None:
        low, high = float(y.min() - (y.max() - y.min())), float(y.max())
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if (y - mid - oasis_ar1(y - mid, g, lam)[0]).mean() > 0 else (low, mid)
        base = high
    return *oasis_ar1(y - base, g, lam), base


def decay_and_rise(g1: float, g2: float) -> tuple[float, float]:
    """The two poles of an AR(2) process, the larger one first; complex ones by their common size, and all held inside (0, 1)."""
    root = g1 * g1 + 4 * g2
    d, r = ((g1 + math.sqrt(root)) / 2, (g1 - math.sqrt(root)) / 2) if root >= 0 else (math.sqrt(-g2), math.sqrt(-g2) * 0.999)
    return min(max(d, 1e-3), 0.999), min(max(r, 1e-6), 0.998)


def two_exponentials(d: float, r: float, window: int) -> np.ndarray:
    """Response d^t - r^t over d - r at t = 1, 2, ...."""
    t = np.arange(1, window + 1)
    return (d**t - r**t) / (d - r)


def ar_coefficients(y: np.ndarray, order: int, noise: float, lags: int = 5) -> np.ndarray:
    """Coefficients by least squares on ``lags`` lags of the autocovariance, the noise taken off lag zero."""
    x = y - y.mean()
    v = np.array([x[k:] @ x[: len(x) - k] / len(x) for k in range(lags + order + 1)])
    v[0] -= noise**2
    rows = np.array([[v[abs(i - j)] for j in range(1, order + 1)] for i in range(1, lags + order + 1)])
    return np.linalg.lstsq(rows, v[1 : lags + order + 1], rcond=None)[0]


def deconvolve(y: np.ndarray, kind: str = "ar1", method: str = "foopsi", pars=None, noise: float | None = None, lam: float = 0.0, smin: float = 0.0, base: float | None = 0.0, window: int = 200) -> dict:
    """``c, s, base, pars`` of one trace.

    ``kind``: ar1, ar2 (coefficients), exp2 (poles) or kernel (samples of the response);
    ``method``: foopsi (penalty ``lam``), constrained (the residual is the noise) or
    thresholded (spikes of at least ``smin``; 0 for ar1: as large as the noise allows).
    Missing parameters and noise are estimated; ``base`` None fits the baseline too, by
    turns with the spikes (``settled``: whether it came to rest). Estimated AR(2) parameters whose poles are complex
    are replaced by their common size, a double real pole (``oscillates``).
    """
    noise, oscillates, settled = welch_noise(y) if noise is None else noise, False, True
    if pars is None:
        g = ar_coefficients(y, 1 if kind == "ar1" else 2, noise)
        if kind == "ar1":
            pars = [min(max(float(g[0]), 0.05), 0.98)]
        else:
            oscillates = g[0] ** 2 + 4 * g[1] < 0
            d, r = decay_and_rise(*g)
            pars = [d + r, -d * r] if kind == "ar2" else [d, r] if kind == "exp2" else two_exponentials(d, r, window)
    if kind != "ar1":
        kernel = ar2_response(float(pars[0]), float(pars[1]), window) if kind == "ar2" else two_exponentials(*pars, window) if kind == "exp2" else np.asarray(pars, float)
    kept: dict = {"grams": {}}

    def spikes_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(c, s) of the trace above a baseline; the next baseline's fit starts where this one ended."""
        if kind == "ar1":
            g = float(pars[0])
            if method == "constrained":
                return constrained_ar1(x, g, noise)[:2]
            return oasis_ar1(x, g, lam, smin) if smin else thresholded_ar1(x, g, noise)[:2]
        if method == "thresholded":
            return thresholded_spikes(x, kernel, smin, kept)
        fit = convolution_nnls(x, kernel, lam, start=kept.get("s"), grams=kept["grams"])
        kept["s"] = fit[1]
        return _constrained(x, kernel, noise, start=fit[1], grams=kept["grams"]) if method == "constrained" else fit

    if kind == "ar1" and method == "foopsi":
        c, s, b = foopsi_ar1(y, float(pars[0]), lam, base)
    else:
        if base is None:
            from .spikes import settled_base

            b, settled = settled_base(y, lambda x: spikes_of(x)[0])
        else:
            b = base
        c, s = spikes_of(y - b)
    return {"c": c, "s": s, "base": float(b), "pars": [float(x) for x in pars], "settled": settled, "oscillates": bool(oscillates)}


def _constrained(y: np.ndarray, kernel: np.ndarray, noise: float, steps: int = 20, start: np.ndarray | None = None, grams: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(c, s) at the largest penalty whose residual stays within the noise, by bisection."""
    limit = noise**2 * len(y)
    low, high = 0.0, max(float(y.max()), 1e-9)
    grams = {} if grams is None else grams
    fit = convolution_nnls(y, kernel, low, start=start, grams=grams)
    for _ in range(steps):
        mid = (low + high) / 2
        new = convolution_nnls(y, kernel, mid, start=fit[1], grams=grams)
        if ((y - new[0]) ** 2).sum() <= limit:
            low, fit = mid, new
        else:
            high = mid
    return fit


def thresholded_ar1(y: np.ndarray, g: float, noise: float, steps: int = 9) -> tuple[np.ndarray, np.ndarray, float]:
    """(c, s, least spike): the largest least spike whose residual stays within the noise, by bisection."""
    limit = noise**2 * len(y)
    rss = lambda m: float(((y - oasis_ar1(y, g, 0.0, m)[0]) ** 2).sum())
    low, high = 0.0, float(max(y.max() - y.min(), 1e-9))
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if rss(mid) <= limit else (low, mid)
    return *oasis_ar1(y, g, 0.0, low), low


def nnls(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Non-negative least squares by an active set on the normal equations, until the optimality conditions hold."""
    return nnls_normal(a.T @ a, a.T @ y)


def nnls_normal(gram: np.ndarray, b: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """The same from the normal equations; ``start`` is a first guess, of which the support is taken."""
    x, passive = np.zeros(len(b)), np.zeros(len(b), bool)
    if start is not None and (start > 0).any():
        passive = start > 0
        while passive.any():
            s = _solved(gram[np.ix_(passive, passive)], b[passive])
            if (s > 0).all():
                x[passive] = s
                break
            passive[np.flatnonzero(passive)[s <= 0]] = False
    # columns that rounding took out at once: they wait until another one moves the fit
    waiting = np.zeros(len(b), bool)
    scale = max(1.0, np.abs(b).max(initial=0.0))
    for _ in range(10 * len(x) + 10):
        w = b - gram @ x
        free = np.where(~passive & ~waiting, w, -np.inf)
        j = int(free.argmax()) if len(x) else 0
        if not len(x) or free[j] <= 1e-10 * scale:
            if w[waiting].max(initial=0.0) > 1e-6 * scale:
                break
            return x
        passive[j], before = True, x
        while passive.any():
            s = np.zeros(len(x))
            s[passive] = _solved(gram[np.ix_(passive, passive)], b[passive])
            if (s[passive] > 0).all():
                x = s
                break
            bad = passive & (s <= 0)
            step = (x[bad] / np.maximum(x[bad] - s[bad], 1e-300)).min()
            x = x + step * (s - x)
            passive &= x > 1e-12
            x[~passive] = 0.0
        if np.abs(x - before).max() > 1e-12 * max(1.0, x.max()):
            waiting[:] = False
        else:
            passive[j], waiting[j] = False, True
            x = np.where(passive, x, 0.0)
    raise RuntimeError("nnls: the steps ended without an optimum")


def _solved(gram: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of the normal equations; the one of least norm where they are singular."""
    try:
        s = np.linalg.solve(gram, b)
        if np.abs(gram @ s - b).max() <= 1e-9 * max(1.0, np.abs(b).max()):
            return s
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(gram, b, rcond=None)[0]


def nnls_pivoted(gram: np.ndarray, b: np.ndarray, start: np.ndarray, rounds: int = 50) -> np.ndarray:
    """The same of a definite ``gram`` by block pivoting: all entries on the wrong side change sides at once, one at a time where that does not
    lessen them. ``start`` tells the first positive ones. What does not end goes to the active set."""
    passive, least, spare = start > 0, len(b) + 1, 3
    scale = 1e-10 * max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(rounds):
        x = np.zeros(len(b))
        own = np.flatnonzero(passive)
        if len(own):
            x[own] = _solved(gram[own[:, None], own], b[own])
        wrong = np.where(passive, x < 0.0, b - gram @ x > scale)
        n = int(np.count_nonzero(wrong))
        if not n:
            return x
        if n < least:
            least, spare = n, 3
        elif spare:
            spare -= 1
        else:
            at = np.flatnonzero(wrong)[-1]
            wrong[:] = False
            wrong[at] = True
        passive ^= wrong
    return nnls_normal(gram, b, start)


def convolution_nnls(y: np.ndarray, kernel: np.ndarray, lam: float = 0.0, allowed: np.ndarray | None = None, window: int = 200, sweeps: int = 200, tol: float = 1e-9, start: np.ndarray | None = None, grams: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(c, s): non-negative spikes under any causal kernel, at the ``allowed`` samples only.

    Windows of spikes are fitted one after the other with the rest fixed, each half a
    window on from the last, in sweeps until none moves; the problem is convex, so this
    ends at its optimum, from any ``start``. Inside, all windows share one small Gram matrix; ``grams`` keeps those of one kernel for further traces.
    """
    n, kernel = len(y), np.asarray(kernel, float)[: len(y)]
    s, rest = np.zeros(n), y - lam
    if start is not None and n:
        s = np.asarray(start, float).copy() if allowed is None else np.where(allowed, start, 0.0)
        rest = rest - np.convolve(s, kernel)[:n]
    blocks = [(a, min(a + window, n)) for a in range(0, max(1, n - window // 2), window // 2)] if n else []
    grams = {} if grams is None else grams

    def columns(rows: int, size: int) -> np.ndarray:
        lag = np.arange(rows)[:, None] - np.arange(size)[None, :]
        return np.where((lag >= 0) & (lag < len(kernel)), kernel[np.clip(lag, 0, len(kernel) - 1)], 0.0)

    for _ in range(sweeps if blocks else 0):
        moved = 0.0
        for a, b in blocks:
            end = min(n, b + len(kernel) - 1)
            if (end - a, b - a) not in grams:
                k = columns(end - a, b - a)
                grams[end - a, b - a] = k.T @ k
            gram = grams[end - a, b - a]
            wanted = np.correlate(np.append(rest[a:end], np.zeros(len(kernel) - 1 - (end - b))), kernel, "valid")[: b - a] + gram @ s[a:b]
            if allowed is None:
                new = nnls_pivoted(gram, wanted, s[a:b])
            else:
                own = a + np.flatnonzero(allowed[a:b])
                if not len(own):
                    continue
                new = np.zeros(b - a)
                new[own - a] = nnls_pivoted(gram[(own - a)[:, None], own - a], wanted[own - a], s[own])
            change = new - s[a:b]
            if np.abs(change).max() > 0:
                rest[a:end] -= np.convolve(change, kernel)[: end - a]
                s[a:b] = new
                moved = max(moved, float(np.abs(change).max()))
        if moved <= tol * max(1.0, float(s.max())) or len(blocks) == 1:
            return np.convolve(s, kernel)[:n], s
    if not blocks:
        return s, s
    raise RuntimeError("convolution_nnls: the sweeps ended without an optimum")


def ar2_response(g1: float, g2: float, n: int) -> np.ndarray:
    """First ``n`` values of the response of an AR(2) process to one spike."""
    h = np.zeros(n)
    for t in range(n):
        h[t] = float(t == 0) + (g1 * h[t - 1] if t else 0.0) + (g2 * h[t - 2] if t > 1 else 0.0)
    return h


def thresholded_spikes(y: np.ndarray, kernel: np.ndarray, smin: float, kept: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(c, s): non-negative spikes of at least ``smin``; smaller ones are dropped and the others fitted again until none is left.

    ``kept`` carries first fits and Gram matrices over to the next trace of the same length and kernel: the fit of a trace like this one starts at them.
    """
    kept = {} if kept is None else kept
    own, s = np.ones(len(y), bool), kept.get("s")
    while True:
        c, s = convolution_nnls(y, kernel, allowed=own, start=s, grams=kept.setdefault("grams", {}))
        if own.all():
            kept["s"] = s
        small = own & (s < smin)
        if not small.any():
            return c, s
        own &= ~small


def spline_basis(n: int, pieces: int, degree: int = 3) -> np.ndarray:
    """``n`` by ``pieces + degree`` values of the B-splines over ``pieces`` equal spans of [0, 1], by their recursion."""
    x = np.linspace(0, 1, n)
    knots = np.concatenate([np.zeros(degree), np.linspace(0, 1, pieces + 1), np.ones(degree)])
    last = knots[:-1].searchsorted(1.0) - 1
    b = np.stack([((a <= x) & (x < z)) | ((i == last) & (x == 1)) for i, (a, z) in enumerate(zip(knots[:-1], knots[1:], strict=True))], axis=1).astype(float)
    for d in range(1, degree + 1):
        left = [(x - knots[i]) / (knots[i + d] - knots[i]) * b[:, i] if knots[i + d] > knots[i] else np.zeros(n) for i in range(b.shape[1] - 1)]
        right = [(knots[i + d + 1] - x) / (knots[i + d + 1] - knots[i + 1]) * b[:, i + 1] if knots[i + d + 1] > knots[i + 1] else np.zeros(n) for i in range(b.shape[1] - 1)]
        b = np.stack(left, axis=1) + np.stack(right, axis=1)
    return b


def spline_detrended(y: np.ndarray, pieces: int) -> np.ndarray:
    """The trace less its least-squares cubic spline."""
    basis = spline_basis(len(y), pieces)
    return y - basis @ np.linalg.lstsq(basis, y, rcond=None)[0]


def busiest(y: np.ndarray, window: int) -> tuple[int | None, float | None]:
    """(start, mean) of the ``window`` frames with the largest mean, the first of equal ones; none in shorter traces."""
    if len(y) < window:
        return None, None
    sums = np.round(np.convolve(y, np.ones(window), "valid"), 9)
    at = int(sums.argmax())
    return at, float(y[at : at + window].mean())


def exceedance(y: np.ndarray, frames: int, tail: str = "gaussian", factor: float = 3.0) -> dict:
    """How unlikely the trace's best ``frames`` frames in a row are as noise around the mode of its density.

    The noise is that of the samples below the mode, as half of a normal distribution.
    ``gaussian``: least causal sum of log upper tails of values over ``factor`` noises;
    ``extreme``: exp of the largest causal sum of log Gumbel probabilities (of the
    maximum of as many frames as the trace has) over the root of ``frames``.
    """
    mode = float(percentile_levels(y, len(y), len(y))[0][0])
    below = y[y < mode]
    noise = float(below.std(ddof=1)) / math.sqrt(1 - 2 / math.pi) if len(below) > 1 else 0.0
    z = (y - mode) / (factor * noise) if noise > 0 else np.zeros(len(y))
    if tail == "gaussian":
        logs = np.array([math.log(max(0.5 * math.erfc(x / math.sqrt(2)), 1e-300)) for x in z])
        value = float(np.convolve(logs, np.ones(frames))[: len(y)].min())
    else:
        middle = NORMAL.inv_cdf(1 - 1 / len(y))
        spread = NORMAL.inv_cdf(1 - math.exp(-1) / len(y)) - middle
        logs = -np.exp(np.minimum(-(z - middle) / spread, 700.0))
        value = float(np.exp((np.convolve(logs, np.ones(frames))[: len(y)] / math.sqrt(frames)).max()))
    return {"mode": mode, "noise": noise, "fitness": value}


def soft_hals(u: np.ndarray, v: np.ndarray, threshold: np.ndarray, mask: np.ndarray, sweeps: int = 40, tol: float = 1e-3) -> np.ndarray:
    """One pixel's weights: coordinate descent with soft thresholds on u = C y, v = C C'."""
    a = np.zeros(len(u))
    for _ in range(sweeps):
        old = a.copy()
        for k in np.flatnonzero(mask & (np.diag(v) > 0)):
            a[k] = max(0.0, a[k] + (u[k] - v[k] @ a - threshold[k]) / v[k, k])
        if np.abs(a - old).sum() <= tol * max(np.abs(old).sum(), 1e-12):
            break
    return a


def greedy_components(frame: np.ndarray, trace: np.ndarray, count: int, radius: float = 2.0, rounds: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Up to ``count`` (footprint, trace) of one patch: the largest blurred energy, refined by alternating fits, taken off.

    ``frame``: row and column of each pixel; ``trace``: pixels by frames.
    """
    rest = trace - np.median(trace, axis=1, keepdims=True)
    near = ((frame[:, None, :] - frame[None, :, :]) ** 2).sum(axis=2)
    blur = np.exp(-near / (2 * radius**2 / 4))
    blur /= np.sqrt((blur**2).sum(axis=1, keepdims=True))
    found = []
    for _ in range(count):
        energy = ((blur @ rest) ** 2).sum(axis=1)
        box = np.flatnonzero(near[int(energy.argmax())] <= radius**2 * 2)
        a, own = np.ones(len(box)), rest[box]
        for _ in range(rounds):
            c = np.maximum(0.0, a @ own) / max(a @ a, 1e-12)
            a = np.maximum(0.0, own @ c) / max(c @ c, 1e-12)
        if not a.any() or not c.any():
            break
        full = np.zeros(len(frame))
        full[box] = a
        found.append((full, c))
        rest = rest - full[:, None] * c
    return found


def hals(y: np.ndarray, a: np.ndarray, c: np.ndarray, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Alternating non-negative updates of footprints (pixels by K) and traces (K by frames), freshest values first."""
    a, c = a.copy(), c.copy()
    for _ in range(rounds):
        u, v = a.T @ y, a.T @ a
        for k in np.flatnonzero(np.diag(v) > 0):
            c[k] = np.maximum(0.0, c[k] + (u[k] - v[k] @ c) / v[k, k])
        u, v = y @ c.T, c @ c.T
        for k in np.flatnonzero(np.diag(v) > 0):
            a[:, k] = np.maximum(0.0, a[:, k] + (u[:, k] - a @ v[:, k]) / v[k, k])
    return a, c


def rank_one(a: np.ndarray, c: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """One (footprint, trace) of unit footprint for the product of several, by power iterations."""
    own = c.sum(axis=0)
    foot = a.sum(axis=1)
    for _ in range(rounds):
        foot = np.maximum(0.0, a @ (c @ own)) / max(own @ own, 1e-12)
        own = np.maximum(0.0, (foot @ a) @ c) / max(foot @ foot, 1e-12)
    norm = np.sqrt(foot @ foot) or 1.0
    return foot / norm, own * norm
