"""Component starts for one patch under strong background: seeds where local correlation times peak-to-noise is largest."""

from __future__ import annotations

import numpy as np

from .images import centre_surround
from .numerics import noise_level

EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def _filter(cube: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    half = kernel.shape[0] // 2
    padded = np.pad(cube, ((half, half), (half, half), (0, 0)), mode="edge")
    out = np.zeros_like(cube)
    for i, j in zip(*np.nonzero(kernel), strict=True):
        out += kernel[i, j] * padded[i : i + cube.shape[0], j : j + cube.shape[1]]
    return out


def _maps(filtered: np.ndarray, level: float) -> tuple[np.ndarray, np.ndarray]:
    """(local correlation, peak-to-noise) of filtered traces; noise under ``level`` deviations does not count in the former."""
    z = filtered - np.median(filtered, axis=2, keepdims=True)
    noise = np.apply_along_axis(noise_level, 2, z)
    pnr = np.divide(z.max(axis=2), noise, out=np.zeros(noise.shape), where=noise > 0)
    z = np.where(z >= level * noise[:, :, None], z, 0.0)
    z -= z.mean(axis=2, keepdims=True)
    size = np.sqrt((z * z).sum(axis=2))
    total, n = np.zeros(size.shape), np.zeros(size.shape)
    rows, columns = size.shape
    for a, b in EIGHT:
        here = np.s_[max(0, -a) : rows - max(0, a), max(0, -b) : columns - max(0, b)]
        there = np.s_[max(0, a) : rows - max(0, -a), max(0, b) : columns - max(0, -b)]
        norm = size[here] * size[there]
        total[here] += np.divide((z[here] * z[there]).sum(axis=2), norm, out=np.zeros(norm.shape), where=norm > 0)
        n[here] += 1
    return total / np.maximum(n, 1), pnr


def _around(cube: np.ndarray, seed: tuple[int, int], half: int):
    r, c = seed
    return np.s_[max(0, r - half) : min(cube.shape[0], r + half + 1), max(0, c - half) : min(cube.shape[1], c + half + 1)]


def footprint_and_trace(cube: np.ndarray, filtered: np.ndarray, seed: tuple[int, int], half: int, alike: float) -> tuple[np.ndarray, np.ndarray]:
    """(footprint, trace) around a seed: the mean of the filtered traces that correlate with the seed's, and the slope of the raw
    traces on it beside a level and the box's mean trace, positive and in one piece with the seed."""
    box = _around(cube, seed, half)
    own = filtered[box].reshape(-1, cube.shape[2])
    z = own - own.mean(axis=1, keepdims=True)
    at = filtered[seed] - filtered[seed].mean()
    norm = np.sqrt((z * z).sum(axis=1) * (at @ at))
    c = own[np.divide(z @ at, norm, out=np.zeros(len(z)), where=norm > 0) > alike].mean(axis=0)
    c = c - np.median(c)
    y = cube[box].reshape(-1, cube.shape[2])
    edge = np.sqrt(((np.indices(cube[box].shape[:2]) - np.array([seed[0] - box[0].start, seed[1] - box[1].start])[:, None, None]) ** 2).sum(axis=0)).ravel() >= half
    level = np.median(y[edge], axis=0) if edge.any() else np.zeros(len(c))
    slope = np.linalg.lstsq(np.stack([c, level, np.ones(len(c))], axis=1), y.T, rcond=None)[0][0]
    shape = np.maximum(0.0, slope).reshape(cube[box].shape[:2])
    shape[shape < 0.1 * shape.max()] = 0.0
    kept, grow = np.zeros(shape.shape, bool), [(seed[0] - box[0].start, seed[1] - box[1].start)]
    while grow:
        i, j = grow.pop()
        if 0 <= i < shape.shape[0] and 0 <= j < shape.shape[1] and shape[i, j] > 0 and not kept[i, j]:
            kept[i, j] = True
            grow += [(i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)]
    full = np.zeros(cube.shape[:2])
    full[box] = np.where(kept, shape, 0.0)
    return full, np.maximum(0.0, c)


def seeded_components(cube: np.ndarray, count: int, size: int, sigma: float, least_corr: float = 0.5, least_pnr: float = 5.0, level: float = 3.0, alike: float = 0.7, same: float = 0.9) -> list[tuple[np.ndarray, np.ndarray]]:
    """Up to ``count`` (footprint, trace) of one patch, best seed first; each is taken off before the next one.

    A seed that gives too few pixels, or the trace of a component nearby, is passed over.
    """
    kernel = centre_surround(size, sigma)
    rest, filtered = cube.astype(float).copy(), _filter(cube.astype(float), kernel)
    corr, pnr = _maps(filtered, level)
    open_, found = np.ones(corr.shape, bool), []
    while len(found) < count:
        score = np.where(open_ & (corr >= least_corr) & (pnr >= least_pnr), corr * pnr, 0.0)
        if not score.any():
            break
        seed = tuple(int(x) for x in np.unravel_index(int(score.argmax()), score.shape))
        open_[_around(cube, seed, max(1, size // 4))] = False
        a, c = footprint_and_trace(rest, filtered, seed, size, alike)
        near = [old for shape, old in found if (shape * a).any() and c.std() > 0 and np.corrcoef(old, c)[0, 1] > same]
        if (a > 0).sum() < 5 or not c.any() or near:
            continue
        found.append((a, c))
        rest -= a[:, :, None] * c
        filtered -= _filter(a[:, :, None], kernel) * c
        box = _around(cube, seed, 2 * size)
        corr[box], pnr[box] = _maps(filtered[box], level)
    return found
