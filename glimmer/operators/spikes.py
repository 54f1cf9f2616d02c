"""Deconvolution of single traces by pools with two values carried over, and refits of decay, kernel and baseline."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np

from .numerics import _solved, ar2_response, convolution_nnls, nnls_pivoted, oasis_ar1, two_exponentials


def penalised(y: np.ndarray, g: tuple[float, ...], lam: float) -> np.ndarray:
    """``y`` changed so that the plain fit of an AR process to it is the one with penalty ``lam`` on the sum of its spikes."""
    gone = 1.0 - np.cumsum(g)
    out = y - lam * gone[-1]
    for k in range(min(len(g), len(y))):  # the last spikes have shorter responses
        out[len(y) - 1 - k] = y[len(y) - 1 - k] - lam * (gone[k - 1] if k else 1.0)
    return out


def ar2_pools(y: np.ndarray, g1: float, g2: float, lam: float = 0.0, smin: float = 0.0) -> list[tuple[int, int, float, float]]:
    """(start, length, first value, value before) of the pools: stretches without a spike but at their start.

    A pool's samples follow from its first value and the last one of the pool before. A new sample is a
    pool of its own; while a pool starts lower than the one before it predicts (``smin`` more), the two are joined and the first value fitted again.
    """
    n = len(y)
    a = ar2_response(g1, g2, n + 1)
    b = np.concatenate([[0.0], g2 * a[:-1]])
    aa, ab = np.cumsum(a * a), np.cumsum(a * b)
    y = penalised(np.asarray(y, float), (g1, g2), lam)
    start, length, own, first, before = [], [], [], [], []

    def last(i: int, k: int) -> float:
        return a[k] * first[i] + b[k] * before[i]

    for t in range(n):
        start.append(t)
        length.append(1)
        own.append(y[t])  # the samples' product with the response
        before.append(last(-1, length[-2] - 1) if t else 0.0)
        first.append(y[t])
        while len(start) > 1 and first[-1] < last(-2, length[-2]) + smin:
            k, size = length[-2], length[-1]
            own[-2] += a[k : k + size] @ y[start[-1] : start[-1] + size]
            length[-2] += size
            for x in (start, length, own, first, before):
                x.pop()
            k = length[-1]
            first[-1] = (own[-1] - ab[k - 1] * before[-1]) / aa[k - 1]
    return list(zip(start, length, first, before, strict=True))


def oasis_ar2(y: np.ndarray, g1: float, g2: float, lam: float = 0.0, smin: float = 0.0, exact: bool = True, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(c, s) of the non-negative deconvolution of an AR(2) trace.

    Pools are greedy, as a pool's last values act on later ones. ``exact`` (without
    ``smin``) fits spikes around the pools' starts all together and adds samples until
    the optimality conditions of the whole problem hold; s[0] is then the first value.
    Otherwise spikes are read off the pools, those below ``smin`` and in the first three samples set to zero.
    """
    n = len(y)
    pools = ar2_pools(y, g1, g2, lam, smin)
    if not exact or smin:
        c = np.zeros(n)
        a = ar2_response(g1, g2, n + 1)
        for t, k, v, p in pools:
            c[t : t + k] = a[:k] * v + np.concatenate([[0.0], g2 * a[: k - 1]]) * p
        c = np.maximum(c, 0.0)
        s = c.copy()
        s[1:] -= g1 * c[:-1]
        s[2:] -= g2 * c[:-2]
        s[:3] = 0.0
        s[s < max(smin, 1e-12)] = 0.0
        return c, s
    target, kernel = penalised(np.asarray(y, float), (g1, g2), lam), ar2_response(g1, g2, n)
    quiet = np.flatnonzero(np.abs(kernel) > 1e-12 * np.abs(kernel).max()) if n else np.zeros(0, int)
    kernel = kernel[: quiet[-1] + 1] if len(quiet) else kernel
    allowed = np.zeros(n, bool)
    for t, *_ in pools:
        allowed[max(0, t - 2) : t + 3] = True
    scale = 1e-8 * max(1.0, float(np.abs(target).max(initial=0.0)) * float((kernel * kernel).sum()))
    for _ in range(rounds):
        c, s = convolution_nnls(target, kernel, allowed=allowed)
        pull = np.correlate(np.append(target - c, np.zeros(len(kernel) - 1)), kernel, "valid") if n else np.zeros(0)
        more = (pull > scale) & ~allowed
        if not more.any():
            return c, s
        allowed |= more
    raise RuntimeError("oasis_ar2: the rounds ended before the optimum")


def least(f: Callable[[float], float], low: float, high: float, steps: int = 40) -> float:
    """Where ``f`` is least between the bounds, by golden sections."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(steps):
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = f(b)
    return (low + high) / 2


def objective(y: np.ndarray, c: np.ndarray, s: np.ndarray, lam: float) -> float:
    return float(((y - c) ** 2).sum()) / 2 + lam * float(s.sum())


def refitted_decay(y: np.ndarray, lam: float) -> float:
    """Decay at which the penalised fit of ``y`` has the least objective."""
    return least(lambda g: objective(y, *oasis_ar1(y, g, lam), lam), 0.3, 0.999, 16)


def refined_ar1(y: np.ndarray, g: float, lam: float = 0.0, base: float | None = 0.0, fit_g: bool = True, rounds: int = 10, tol: float = 1e-3) -> dict:
    """``c, s, g, base, settled``: AR(1) deconvolution with the decay, and for ``base`` None the baseline, fitted by turns.

    A round with a greater objective than the one before ends it; ``settled`` tells whether both moved by less than ``tol``.
    """
    y = np.asarray(y, float)
    fit_base = base is None
    base = float(np.quantile(y, 0.15)) if fit_base else float(base)
    c, s = oasis_ar1(y - base, g, lam)
    best, settled = objective(y - base, c, s, lam), not (fit_base or fit_g)
    for _ in range(rounds if not settled else 0):
        new_base = float((y - c).mean()) if fit_base else base
        new_g = refitted_decay(y - new_base, lam) if fit_g else g
        new_c, new_s = oasis_ar1(y - new_base, new_g, lam)
        score = objective(y - new_base, new_c, new_s, lam)
        if score > best:
            settled = True
            break
        settled = abs(new_g - g) <= tol * g and abs(new_base - base) <= tol * max(float(np.abs(y).max()), 1e-300)
        c, s, g, base, best = new_c, new_s, new_g, new_base, score
        if settled:
            break
    return {"c": c, "s": s, "g": float(g), "base": base, "settled": settled}


def least_of_many(f: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray, steps: int = 40) -> np.ndarray:
    """``least`` of many functions at once, each between bounds of its own."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(steps):
        left = fa <= fb
        low, high = np.where(left, low, a), np.where(left, b, high)
        at = np.where(left, high - ratio * (high - low), low + ratio * (high - low))
        new = f(at)
        a, b, fa, fb = np.where(left, at, b), np.where(left, a, at), np.where(left, new, fb), np.where(left, fa, new)
    return (low + high) / 2


#: Bytes of the columns of the fits that are tried at once, and most of them.
FIT_BYTES, FITS = 4 << 20, 32


def energies_left(y: np.ndarray, spikes: list[np.ndarray], window: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What the fits of traces (rows of ``y``) by responses at their ``spikes`` leave, for powers d^t and r^t (a row each) of the two poles.

    It is the last pivot of the normal equations with the trace as one more column. The height of a response does not matter. Traces of fewer
    spikes have columns of zeros.
    """
    n, size = y.shape[1], max(len(x) for x in spikes)
    place = np.full((len(y), n, size + 1), window)
    idle = np.zeros((len(y), size))
    for own, no, at in zip(place, idle, spikes, strict=True):
        d = np.arange(n)[:, None] - at
        own[:, : len(at)] = np.where((d >= 0) & (d < window), d, window)
        no[len(at) :] = 1.0
    place[:, :, size] = window + 1 + np.arange(n)
    place += np.arange(len(y))[:, None, None] * (window + 1 + n)
    values, each = np.concatenate([np.zeros((len(y), window + 1)), y], axis=1), np.arange(size)

    def left(dt: np.ndarray, rt: np.ndarray) -> np.ndarray:
        values[:, :window] = dt - rt
        values[:, :window] /= values[:, :1]
        x = values.ravel()[place]
        gram = x.transpose(0, 2, 1) @ x
        gram[:, each, each] += idle
        try:
            return np.linalg.cholesky(gram)[:, size, size] ** 2
        except np.linalg.LinAlgError:  # nothing is left of one, or its columns are not independent
            return np.array([g[size, size] - g[size, :size] @ _solved(g[:size, :size], g[:size, size]) for g in gram])

    return left


def refitted_kernels(traces: list[np.ndarray], d: float, r: float, lam: float = 0.0, window: int = 100, rounds: int = 8, tol: float = 1e-3) -> list[dict]:
    """``c, s, d, r, settled`` of each trace: spikes under a response of two exponentials whose poles d > r are fitted by turns with them.

    Spikes of a tenth of the largest or more stay at their places and are fitted anew for each pole that is tried; the response has unit
    height. Ends where neither pole moves by ``tol`` or the fit gets no better. Poles of many traces are tried at once.
    """
    traces, t = [np.asarray(y, float) for y in traces], np.arange(1, window + 1)
    found = [{"s": None, "d": float(d), "r": float(r), "settled": False} for _ in traces]

    def fitted(i: int) -> None:
        k = two_exponentials(found[i]["d"], found[i]["r"], window)
        found[i]["c"], found[i]["s"] = convolution_nnls(traces[i], k / k.max(), lam, start=found[i]["s"])

    running, places = list(range(len(traces))), {}
    for _ in range(rounds):
        for i in running:
            fitted(i)
            s = found[i]["s"]
            places[i] = np.flatnonzero(s >= 0.1 * s.max(initial=0.0)) if s.any() else np.zeros(0, int)
        # those of one length and about as many spikes together
        running = sorted((i for i in running if len(places[i])), key=lambda i: (len(traces[i]), len(places[i])))
        ahead, part = [], []
        for i, after in itertools.zip_longest(running, running[1:]):
            part.append(i)
            if after is not None and len(traces[after]) == len(traces[i]) and len(part) < FITS and (len(part) + 1) * len(traces[i]) * len(places[after]) * 8 <= FIT_BYTES:
                continue
            left = energies_left(np.stack([traces[j] for j in part]), [places[j] for j in part], window)
            d0, r0 = (np.array([found[j][x] for j in part]) for x in "dr")
            power = lambda x: x[:, None] ** t
            dt, rt = power(d0), power(r0)
            d1 = least_of_many(lambda x: left(power(x), rt), np.minimum(r0 * 1.01 + 1e-3, 0.99), np.full(len(part), 0.999), 16)
            new = power(d1)
            r1 = least_of_many(lambda x: left(new, power(x)), np.full(len(part), 1e-3), d1 * 0.99, 16)
            still = (np.abs(d1 - d0) <= tol * d0) & (np.abs(r1 - r0) <= tol * np.maximum(r0, 1e-2))
            worse = left(new, power(r1)) >= left(dt, rt)
            for j, *pair, rest, no in zip(part, d1.tolist(), r1.tolist(), still.tolist(), worse.tolist(), strict=True):
                if not no:
                    found[j]["d"], found[j]["r"] = pair
                found[j]["settled"] = no or rest
                if not found[j]["settled"]:
                    ahead.append(j)
            part = []
        running = ahead
    for i in range(len(traces)):
        fitted(i)
    return found


def refitted_kernel(y: np.ndarray, d: float, r: float, lam: float = 0.0, window: int = 100, rounds: int = 8, tol: float = 1e-3) -> dict:
    """``refitted_kernels`` of one trace."""
    return refitted_kernels([y], d, r, lam, window, rounds, tol)[0]


def thinned_kernel(kernel: np.ndarray, step: int) -> np.ndarray:
    """A response for traces of which ``step`` samples are averaged into one: sums of as many of its averages, divided by ``step``."""
    n = -(-len(kernel) // step) + 1
    full = np.zeros(n * step)
    spread = np.convolve(kernel, np.ones(step) / step)  # spikes fall anywhere in a bin
    full[: min(len(spread), len(full))] = spread[: len(full)]
    return full.reshape(n, step).mean(axis=1)


def settled_base(y: np.ndarray, fit: Callable[[np.ndarray], np.ndarray], rounds: int = 12, tol: float = 1e-3) -> tuple[float, bool]:
    """(baseline, settled): where the mean of what the fit of the trace above the baseline leaves is zero, to ``tol`` of the trace's range.

    From the 15 % quantile on by secants; that mean falls as the baseline rises.
    """
    base, scale = float(np.quantile(y, 0.15)), max(float(y.max() - y.min()), 1e-300)
    left = lambda b: float((y - b - fit(y - b)).mean())
    mean = left(base)
    slope = -1.0
    for _ in range(rounds):
        if abs(mean) <= tol * scale:
            return base, True
        move = min(max(-mean / slope, -scale / 4), scale / 4)
        new = left(base + move)
        slope = min((new - mean) / move, -1e-2)
        base, mean = base + move, new
    return base, abs(mean) <= tol * scale


def free_fit(y: np.ndarray, g: tuple[float, ...], lam: float, low: float | None, first: bool, guess: np.ndarray, steps: int = 1000) -> tuple[np.ndarray, float, float, np.ndarray]:
    """(spikes, baseline, initial value, samples that may hold a spike) of the least squares with penalty ``lam`` on the sum of spikes only.

    ``low``: least baseline, or None for none; ``first``: whether an initial value that decays by the largest pole is fitted; it
    stands for a spike at the first sample too, which would be the same with a smaller one after it.
    Samples are added to ``guess`` until the optimality conditions of the whole problem hold.
    """
    n = len(y)
    h = ar2_response(g[0], g[1] if len(g) > 1 else 0.0, n)
    h[np.abs(h) < 1e-12 * np.abs(h).max()] = 0.0
    pole = max(abs(x) for x in np.roots([1.0, *(-x for x in g)]))
    extra = np.stack([x for x in (None if low is None else np.ones(n), pole ** np.arange(n) if first else None) if x is not None] or [np.zeros(n)], axis=1)
    target = y - (low or 0.0)
    allowed, s, usable = guess.copy(), np.zeros(n), np.arange(n) >= int(first)
    for _ in range(steps):
        allowed &= usable
        at = np.flatnonzero(allowed)
        lag = np.arange(n)[:, None] - at
        a = np.concatenate([np.where(lag >= 0, h[np.clip(lag, 0, n - 1)], 0.0), extra], axis=1)
        pull = a.T @ target - lam * (np.arange(a.shape[1]) < len(at))
        # an idle column of zeros takes no part
        x = nnls_pivoted(a.T @ a, pull, np.concatenate([s[at], extra.any(axis=0)]))
        s = np.zeros(n)
        s[at] = x[: len(at)]
        more = np.correlate(np.append(target - a @ x, np.zeros(n - 1)), h, "valid") - lam
        missing = ~allowed & usable & (more > 1e-8 * max(1.0, float(np.abs(pull).max())))
        if not missing.any():
            b = x[len(at)] + low if low is not None else 0.0
            return s, float(b), float(x[-1]) if first else 0.0, allowed
        allowed |= missing
    raise RuntimeError("free_fit: the steps ended before the optimum")


def constrained_fit(y: np.ndarray, g: tuple[float, ...], noise: float, base: float | None = None, first: float | None = None, low: float | None = None, steps: int = 60, tol: float = 1e-6) -> dict:
    """``c, s, base, first, lam, settled``: the spikes of least sum whose residual stays within the noise.

    The residual's energy is held to noise^2 times the samples. ``base`` and ``first`` (value of an initial transient that decays
    by the largest pole) are fitted where None; the baseline is ``low`` or more (least sample unless given). By the dual: the energy
    rises with the penalty, whose value at the limit is bracketed and found by secants on the bracket. A limit that even no penalty
    meets gives the least-squares fit, one that no spikes at all meet a fit without spikes (``settled`` false for both). Missing
    samples (NaN) have no part in the fit and are filled on a line first. An empty trace has empty spikes.
    """
    n = len(y)
    if not n or np.isnan(y).all():
        return {"c": [0.0] * n, "s": [0.0] * n, "base": base or 0.0, "first": first or 0.0, "lam": 0.0, "settled": False}
    known = ~np.isnan(y)
    y = np.interp(np.arange(n), np.flatnonzero(known), y[known])
    pole = max(abs(x) for x in np.roots([1.0, *(-x for x in g)]))
    unit = float(y.std()) or 1.0  # tolerances are those of traces of unit spread
    least_base = None if base is not None else (float(y.min()) if low is None else low) / unit
    rest, h = (y - (base or 0.0) - (first or 0.0) * pole ** np.arange(n)) / unit, ar2_response(g[0], g[1] if len(g) > 1 else 0.0, n)
    allowed = np.zeros(n, bool)
    for t, *_ in ar2_pools(rest - (np.quantile(rest, 0.15) if base is None else 0.0), g[0], g[1] if len(g) > 1 else 0.0):
        allowed[max(0, t - 1) : t + 2] = True

    def solve(lam: float):
        nonlocal allowed
        s, b, c1, allowed = free_fit(rest, g, lam, least_base, first is None, allowed)
        c = np.convolve(s, h)[:n]
        return float(((rest - c - b - c1 * pole ** np.arange(n)) ** 2).sum()), s, c, b, c1

    limit, lam, settled = (noise / unit) ** 2 * n, 0.0, False
    now = solve(0.0)
    if now[0] < limit:
        # no spike pays at this penalty
        high = float(np.correlate(np.append(rest - rest.min(), np.zeros(n - 1)), h, "valid").max()) + 1e-12
        under, over, last = (0.0, now[0]), (high, solve(high)[0]), 0
        lam, now = (high, solve(high)) if over[1] <= limit else (lam, now)
        while over[1] > limit and steps and not settled:
            steps -= 1
            # on the root of the energies the curve is nearly straight; every third step halves, so the bracket always shrinks
            a, b, m = (math.sqrt(x) for x in (under[1], over[1], limit))
            part = 0.5 if last >= 2 else (m - a) / (b - a)
            lam = under[0] + min(max(part, 0.01), 0.99) * (over[0] - under[0])
            now = solve(lam)
            last = 0 if last >= 2 else last + 1
            under, over = ((lam, now[0]), over) if now[0] <= limit else (under, (lam, now[0]))
            settled = abs(now[0] - limit) <= tol * limit
    _, s, c, b, c1 = now
    return {"c": (c * unit).tolist(), "s": (s * unit).tolist(), "base": b * unit if base is None else base, "first": c1 * unit if first is None else first, "lam": lam * unit, "settled": settled}
