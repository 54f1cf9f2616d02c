"""Summary images and resampling of packed movies (``px, r, c, trace``)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import mean
from .numerics import map_traces, noise_level

FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def annulus(least: float, most: float) -> list[tuple[int, int]]:
    """Offsets at a distance of at least ``least`` and below ``most``."""
    n = math.ceil(most)
    return [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if least <= math.hypot(a, b) < most]


#: Side of the square tiles that images of neighbourhoods are computed on; a tile gets the pixels around it that its own ones reach.
TILE = 32


def tiles(pixels: DataFrame, reach: int) -> DataFrame:
    """``pixels`` under each tile (``tr, tc``) that holds them or lies within ``reach`` of them: only those near an edge are sent twice."""
    near = lambda x: F.explode(F.sequence(F.floor((F.col(x) - reach) / TILE), F.floor((F.col(x) + reach) / TILE)))
    return pixels.withColumn("tr", near("r")).withColumn("tc", near("c"))


def half_of(offsets: list[tuple[int, ...]]) -> list[tuple[int, int, int]]:
    """One of each pair of opposite offsets, in rows, columns and planes."""
    full = [(*x, 0)[:3] for x in offsets]
    if {(-a, -b, -c) for a, b, c in full} != set(full):
        raise ValueError("neighbourhoods are symmetric")
    return [x for x in full if x > (-x[0], -x[1], -x[2])]


def block_bounds(n: int, block: int | None, least: int) -> list[tuple[int, int]]:
    """Blocks of frames; a last one of ``least`` frames or fewer joins the one before. None: one block."""
    count = max(1, n // block + (n % block > least)) if block else 1
    return [(i * block, n if i == count - 1 else (i + 1) * block) for i in range(count)] if block else [(0, n)]


def correlation_image(pixels: DataFrame, offsets: list[tuple[int, ...]], block: int | None = None, least: int = 0) -> DataFrame:
    """Mean correlation ``rho`` of each pixel with the neighbours it has (borders: fewer); with ``block``, its maximum over blocks of frames.

    Tiles with a margin are grouped, so a pixel is shuffled once, or a few times at a
    tile's edge; in a tile every trace is standardised once and each pair of
    neighbours multiplied once. Pixels without neighbours or variance have no row.
    A volume has a column ``z`` and offsets of three numbers; a tile holds all planes.
    """
    half = half_of(offsets)
    reach = max(max(abs(a), abs(b)) for a, b, _ in half)

    def run(key, table):
        r, c, z_of, px = (table.column(x).to_numpy() for x in ("r", "c", "z", "px"))
        traces = table.column("trace").combine_chunks()
        y = traces.flatten().to_numpy(zero_copy_only=False).reshape(len(px), -1)
        side, planes = TILE + 2 * reach, int(z_of.max() - z_of.min()) + 1
        at = np.full((side, side, planes), -1)
        at[r - key[0].as_py() * TILE + reach, c - key[1].as_py() * TILE + reach, z_of - z_of.min()] = np.arange(len(px))
        best = np.full(len(px), -np.inf)
        for a, b in block_bounds(y.shape[1], block, least):
            z = y[:, a:b] - y[:, a:b].mean(axis=1, keepdims=True)
            size = np.sqrt((z * z).mean(axis=1))
            z /= np.where(size > 0, size, 1.0)[:, None]
            total, n = np.zeros(len(px)), np.zeros(len(px))
            for step in half:
                near = tuple(slice(max(0, -d), max(0, x - max(0, d))) for d, x in zip(step, at.shape, strict=True))
                far = tuple(slice(x.start + d, max(x.start, x.stop) + d) for x, d in zip(near, step, strict=True))
                i, j = at[near].ravel(), at[far].ravel()
                both = (i >= 0) & (j >= 0)
                i, j = i[both], j[both]
                both = (size[i] > 0) & (size[j] > 0)
                i, j = i[both], j[both]
                rho = np.einsum("ij,ij->i", z[i], z[j]) / (b - a)
                for k in (i, j):
                    total += np.bincount(k, rho, len(px))
                    n += np.bincount(k, minlength=len(px))
            best = np.maximum(best, np.divide(total, n, out=np.full(len(px), -np.inf), where=n > 0))
        own = (r // TILE == key[0].as_py()) & (c // TILE == key[1].as_py()) & np.isfinite(best)
        return pa.table({"px": px[own], "rho": best[own]})

    z = F.col("z").cast("int") if "z" in pixels.columns else F.lit(0)
    d = tiles(pixels.select("px", F.col("r").cast("int"), F.col("c").cast("int"), z.alias("z"), "trace"), reach)
    return d.groupBy("tr", "tc").applyInArrow(run, "px long, rho double")


def neighbourhood(radius: float, planes: int = 0) -> list[tuple[int, int, int]]:
    """Offsets of a volume within ``radius`` in a plane, over ``planes`` planes above and below."""
    n = math.ceil(radius)
    return [(a, b, c) for a in range(-n, n + 1) for b in range(-n, n + 1) for c in range(-planes, planes + 1) if 0 < a * a + b * b + c * c and math.hypot(a, b) <= radius]


def filtered(pixels: DataFrame, kernel: np.ndarray, rows: int, columns: int) -> DataFrame:
    """``px, r, c, trace``: correlation with an odd square ``kernel``; beyond the field the border pixel is repeated.

    Pixels that the movie lacks count as zero.
    """
    reach = kernel.shape[0] // 2

    def run(key, table):
        r, c, px = (table.column(x).to_numpy() for x in ("r", "c", "px"))
        y = table.column("trace").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(px), -1)
        r0, c0 = key[0].as_py() * TILE - reach, key[1].as_py() * TILE - reach
        at = np.full((TILE + 2 * reach, TILE + 2 * reach), len(px))
        at[r - r0, c - c0] = np.arange(len(px))
        padded = np.concatenate([y, np.zeros((1, y.shape[1]))])
        own = np.flatnonzero((r // TILE == key[0].as_py()) & (c // TILE == key[1].as_py()))
        out = np.zeros((len(own), y.shape[1]))
        for a, b in zip(*np.nonzero(kernel), strict=True):
            row, column = np.clip(r[own] + a - reach, 0, rows - 1), np.clip(c[own] + b - reach, 0, columns - 1)
            out += kernel[a, b] * padded[at[row - r0, column - c0]]
        lists = pa.ListArray.from_arrays((np.arange(len(own) + 1) * y.shape[1]).astype(np.int32), out.ravel())
        return pa.table({"px": px[own], "r": r[own], "c": c[own], "trace": lists})

    d = tiles(pixels.select("px", F.col("r").cast("int"), F.col("c").cast("int"), "trace"), reach)
    return d.groupBy("tr", "tc").applyInArrow(run, "px long, r int, c int, trace array<double>")


def centre_surround(size: int, sigma: float) -> np.ndarray:
    """Gaussian on a disk, less its mean there: flat background gives zero. ``size`` is made odd."""
    half = size // 2
    x = np.arange(-half, half + 1)
    g = np.exp(-(x[:, None] ** 2 + x[None, :] ** 2) / (2 * sigma**2))
    g /= g.sum()
    disk = g >= g[half, 0]
    return np.where(disk, g - g[disk].mean(), 0.0)


def peak_to_noise(pixels: DataFrame, kernel: np.ndarray, rows: int, columns: int, level: float = 5.0) -> DataFrame:
    """``px, r, c, pnr, trace``: filtered traces less their median; their maximum over their noise; and what exceeds ``level`` noises, else zero."""
    d = filtered(pixels, kernel, rows, columns)

    def one(y: np.ndarray) -> dict:
        y = y - np.median(y)
        noise = noise_level(y)
        return {"pnr": float(y.max() / noise) if noise > 0 else None, "trace": np.where(y >= level * noise, y, 0.0).tolist()}

    return map_traces(d, one, "pnr double, trace array<double>", "px", "trace").join(d.select("px", "r", "c"), "px").select("px", "r", "c", "pnr", "trace")


def ring_background(pixels: DataFrame, radius: int, noise: DataFrame, level: float = 3.0, ridge: float = 1e-5) -> DataFrame:
    """``px, trace``: each pixel's background as a linear fit on the centred traces of the ring at ``radius`` ... ``radius`` + 1 around it.

    Frames in which a centred trace exceeds its ring's mean by ``level`` noises
    (``noise``: px, sn) are replaced by that mean first, in the fit's inputs, and left
    out of the pixel's own fit. The mean is added back. Pixels without a ring get their mean.
    """
    ring = [(a, b) for a, b in annulus(radius, radius + 1)]
    reach = max(max(abs(a), abs(b)) for a, b in ring)

    def run(key, table):
        r, c, px, sn = (table.column(x).to_numpy() for x in ("r", "c", "px", "sn"))
        y = table.column("trace").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(px), -1)
        middle = y.mean(axis=1, keepdims=True)
        z, side = y - middle, TILE + 4 * reach
        r0, c0 = key[0].as_py() * TILE - 2 * reach, key[1].as_py() * TILE - 2 * reach
        at = np.full((side + 2 * reach, side + 2 * reach), -1)
        at[r - r0 + reach, c - c0 + reach] = np.arange(len(px))
        near = np.stack([at[r - r0 + reach + a, c - c0 + reach + b] for a, b in ring], axis=1)
        n = (near >= 0).sum(axis=1)
        padded = np.concatenate([z, np.zeros((1, z.shape[1]))])
        around = sum(padded[near[:, i]] for i in range(near.shape[1])) / np.maximum(n, 1)[:, None]
        event = (z - around > level * sn[:, None]) & (n > 0)[:, None]
        calm = np.where(event, around, z)
        own = np.flatnonzero((r // TILE == key[0].as_py()) & (c // TILE == key[1].as_py()))
        out = np.zeros((len(own), y.shape[1]))
        for i, p in enumerate(own.tolist()):
            x = calm[near[p][near[p] >= 0]]
            kept = ~event[p]
            kept[0] = False  # the first frame is left out of every fit
            xx = x[:, kept] @ x[:, kept].T
            if len(x) and np.trace(xx) > 0:
                w = np.linalg.solve(xx + np.eye(len(x)) * np.trace(xx) * ridge, x[:, kept] @ calm[p, kept])
                out[i] = w @ x
        lists = pa.ListArray.from_arrays((np.arange(len(own) + 1) * y.shape[1]).astype(np.int32), (out + middle[own]).ravel())
        return pa.table({"px": px[own], "trace": lists})

    d = pixels.select("px", F.col("r").cast("int"), F.col("c").cast("int"), "trace").join(noise.select("px", "sn"), "px")
    return tiles(d, 2 * reach).groupBy("tr", "tc").applyInArrow(run, "px long, trace array<double>")


def least_value(pixels: DataFrame) -> DataFrame:
    return pixels.agg(F.min(F.array_min("trace")).alias("low"))


def shifted(pixels: DataFrame) -> DataFrame:
    """Traces less the movie's least value (one row, joined by broadcast)."""
    d = pixels.join(F.broadcast(least_value(pixels)), how="left")
    return d.withColumn("trace", F.transform("trace", lambda x: x - F.col("low"))).drop("low")


def unsaturated(pixels: DataFrame, level: float = 0.9, share: float = 0.005) -> DataFrame:
    """Pixels of which less than ``share`` of the frames reach ``level`` of the next power of two above the maximum, less one."""
    top = pixels.agg(F.max(F.array_max("trace")).alias("top")).select((level * (F.pow(F.lit(2.0), F.ceil(F.log2("top"))) - 1)).alias("limit"))
    d = pixels.join(F.broadcast(top), how="left")
    d = d.withColumn("saturated", F.size(F.filter("trace", lambda x: x >= F.col("limit"))) / F.size("trace"))
    return d.where(F.col("saturated") < share).select("px", "saturated")


def downsample_time(pixels: DataFrame, by: int, power: float | None = 1) -> DataFrame:
    """Blocks of ``by`` frames as their mean, power mean, or maximum (``power`` None); the incomplete tail is dropped."""
    n = F.floor(F.size("trace") / by).cast("int")
    part = lambda i: F.slice("trace", i * by + 1, by)
    if power is None:
        value = lambda i: F.array_max(part(i))
    elif power == 1:
        value = lambda i: mean(part(i))
    else:
        value = lambda i: F.pow(mean(F.transform(part(i), lambda x: F.pow(x, F.lit(power)))), F.lit(1 / power))
    return pixels.withColumn("trace", F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), value)).otherwise(F.array().cast("array<double>")))


def downsample_space(movie: DataFrame, by: int) -> DataFrame:
    """Box means of ``by`` x ``by`` pixels of a long movie."""
    return movie.groupBy(F.floor(F.col("r") / by).cast("int").alias("r"), F.floor(F.col("c") / by).cast("int").alias("c"), "t").agg(F.avg("y").alias("y"))


def interpolated(movie: DataFrame) -> DataFrame:
    """Missing samples (null ``y``) on the line through the nearest two known ones, inside and beyond the ends.

    A pixel with one known sample takes it throughout; without any it stays missing.
    """
    known = F.when(F.col("y").isNotNull(), F.struct("t", "y"))
    w = Window.partitionBy("px").orderBy("t")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    d = movie.select("*", F.last(known, True).over(before).alias("a1"), F.first(known, True).over(after).alias("b1"), known.alias("own"))
    # the known sample before the last one, the one after the next: for the ends
    d = d.withColumn("prev", F.when(F.col("own").isNotNull(), F.struct(F.col("t"), F.col("y"), F.col("a1").alias("far")))).withColumn("next", F.when(F.col("own").isNotNull(), F.struct(F.col("t"), F.col("y"), F.col("b1").alias("far"))))
    d = d.withColumn("p", F.last("prev", True).over(before)).withColumn("q", F.first("next", True).over(after))
    line = lambda a, b: a["y"] + F.try_divide((b["y"] - a["y"]) * (F.col("t") - a["t"]), b["t"] - a["t"])
    p, q = F.col("p"), F.col("q")
    value = F.coalesce("y", line(p, q), line(q, q["far"]), line(p["far"], p), q["y"], p["y"])
    return d.select(*[c for c in movie.columns if c != "y"], value.alias("y"))


def gaussian_taps(sigma: float, radius: int) -> list[float]:
    """Taps of unit Euclidean length."""
    raw = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [x / math.sqrt(sum(y * y for y in raw)) for x in raw]


def blurred(pixels: DataFrame, sigma: float, radius: int) -> DataFrame:
    """``px, r, c, trace``: separable Gaussian blur with zero padding, tile by tile with a margin of ``radius``."""
    taps = np.array(gaussian_taps(sigma, radius))

    def run(key, table):
        r, c, px = (table.column(x).to_numpy() for x in ("r", "c", "px"))
        y = table.column("trace").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(px), -1)
        row, column = r - key[0].as_py() * TILE, c - key[1].as_py() * TILE
        # per axis, what a pixel of the tile gets from each place around it
        weight = lambda x: np.where(np.abs(x[:, None] - np.arange(-radius, TILE + radius)) <= radius, taps[np.clip(x[:, None] - np.arange(-radius, TILE + radius) + radius, 0, 2 * radius)], 0.0)
        own = np.flatnonzero((row >= 0) & (row < TILE) & (column >= 0) & (column < TILE))
        across = np.zeros((TILE + 2 * radius, TILE, y.shape[1]))  # rows of places by columns of the tile
        places = weight(np.arange(TILE))
        for i in np.unique(row):
            here = np.flatnonzero(row == i)
            across[i + radius] = places[:, column[here] + radius] @ y[here]
        out = np.einsum("kp,kpt->kt", places[row[own]], across[:, column[own]].swapaxes(0, 1)) if len(own) else np.zeros((0, y.shape[1]))
        lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, max(1, out.shape[1]), dtype=np.int32)[: len(own) + 1], out.ravel())
        return pa.table({"px": px[own], "r": r[own], "c": c[own], "trace": lists})

    d = tiles(pixels.select("px", F.col("r").cast("int"), F.col("c").cast("int"), "trace"), radius)
    return d.groupBy("tr", "tc").applyInArrow(run, "px long, r int, c int, trace array<double>")
