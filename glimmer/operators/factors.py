"""Low-rank models of a movie: non-negative factors, of pixels or of a product of footprints and traces, and background models.

The temporal factors, ``count`` vectors of frames, are the model and live on the
driver; pixels stay where they lie. A round is one pass over them: each task finds its
pixels' weights for the present temporal factors and adds up W'Y and W'W, so neither
weights nor sums of single pixels are shuffled or stored between rounds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .images import TILE, tiles
from .linalg import BLOCK_PIXELS, NORM_BYTES, leading_factors, lists, packed_bytes, sparse_times, unpacked_bytes

#: Sums of tasks are added up in so many groups first.
FAN_IN = 32
VECTORS = "j long, x array<double>"


def matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(n, -1)


def added(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """Sum over all batches of the matrix that ``of`` makes of each; its rows come to the driver. None without rows."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], ["j", "x"])

    def total(table: pa.Table) -> pa.Table:
        return pa.table({"j": table.column("j")[:1], "x": pa.array([matrix(table.column("x"), table.num_rows).sum(axis=0)])})

    parts = rows.mapInArrow(run, VECTORS).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
    parts = parts.groupBy("j", "part").applyInArrow(total, VECTORS).groupBy("j").applyInArrow(total, VECTORS)
    found = sorted((r["j"], np.array(r["x"])) for r in parts.collect())  # as many as the matrix has rows
    return np.stack([x for _, x in found]) if found else None


def weights(y: np.ndarray, h: np.ndarray, exact: bool) -> np.ndarray:
    """Non-negative weights of each row of ``y`` on ``h``: the least-squares ones with negative ones set to zero, or the exact fit."""
    b, g = y @ h.T, h @ h.T
    w = np.maximum(b @ np.linalg.pinv(g), 0.0)
    return descended(w, b, g) if exact else w


def descended(w: np.ndarray, b: np.ndarray, g: np.ndarray, sweeps: int = 500, tol: float = 1e-12) -> np.ndarray:
    """Rows of ``w`` moved to the non-negative minimum of w g w' - 2 b w' by cyclic coordinate descent."""
    w, scale = w.copy(), max(float(np.abs(b).max(initial=0.0)), 1e-300)
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(np.diag(g) > 0):
            new = np.maximum(w[:, j] + (b[:, j] - w @ g[:, j]) / g[j, j], 0.0)
            moved = max(moved, float(np.abs(new - w[:, j]).max(initial=0.0)) * g[j, j])
            w[:, j] = new
        if moved <= tol * scale:
            break
    return w


def frames_of(rows: DataFrame) -> int:
    first = rows.select(F.size("trace")).first()
    return first[0] if first else 0


def weight_rows(rows: DataFrame, h: np.ndarray, exact: bool) -> DataFrame:
    """``px, w``: the weights of every pixel."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                w = weights(matrix(batch.column("trace"), batch.num_rows), h, exact)
                yield pa.RecordBatch.from_arrays([batch.column("px"), pa.array(list(w), pa.list_(pa.float64()))], ["px", "w"])

    return rows.select("px", "trace").mapInArrow(run, "px long, w array<double>")


def signed_start(v: np.ndarray, s: np.ndarray, positive: np.ndarray, negative: np.ndarray, mean: float) -> np.ndarray:
    """Non-negative temporal factors from singular vectors: of each pair the sign with more energy; zeros become ``mean``.

    ``positive, negative``: squared norms of the left vectors' parts of either sign.
    """
    h = np.zeros(v.T.shape)
    for j in range(len(s)):
        parts = [(np.sqrt(positive[j]), np.maximum(v[:, j], 0.0)), (np.sqrt(negative[j]), np.maximum(-v[:, j], 0.0))]
        size, own = max(((u * np.linalg.norm(x), i, x) for i, (u, x) in enumerate(parts)), key=lambda p: (p[0], -p[1]))[::2]
        h[j] = np.sqrt(s[j] * size) * own / (np.linalg.norm(own) or 1.0)
    return np.where(h == 0, mean, h)


def start_factors(rows: DataFrame, count: int) -> np.ndarray:
    """Non-negative temporal factors of ``rows (px, trace)`` from its leading singular vectors."""
    u, s, v = leading_factors(rows, count)

    def signs(batch):
        own = matrix(batch.column("u"), batch.num_rows)
        return np.stack([(np.maximum(own, 0.0) ** 2).sum(axis=0), (np.maximum(-own, 0.0) ** 2).sum(axis=0)])

    energy = added(u.select("u"), signs)
    if energy is None:
        return np.zeros((0, 0))
    mean = rows.select(F.aggregate("trace", F.lit(0.0), lambda a, x: a + x).alias("s"), F.size("trace").alias("n")).agg(F.sum("s") / F.sum("n")).first()[0]
    return signed_start(v, s, *energy, mean)


def nonnegative_factors(rows: DataFrame, count: int, rounds: int = 20, tol: float = 1e-6, method: str = "hals", start: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray, list[float]]:
    """(``px, w``, H, squared errors by round) of the fit Y = W H, both non-negative, to packed ``rows (px, trace)``.

    ``method``: als sets what is negative in the least-squares factors to zero; hals
    moves each factor to its minimum, so the error never rises. Ends after ``rounds``
    or when the error falls by less than ``tol`` of itself (hals). Without rows H is empty.
    """
    h = start_factors(rows, count) if start is None else np.asarray(start, float)
    frames, exact, errors = frames_of(rows), method == "hals", []
    if not frames:
        return rows.select("px", F.array().cast("array<double>").alias("w")), np.zeros((count, 0)), errors
    for _ in range(rounds):

        def sums(batch, h=h):
            y = matrix(batch.column("trace"), batch.num_rows)
            w = weights(y, h, exact)
            size = np.zeros((len(h), 1))
            size[0] = (y * y).sum()
            return np.hstack([w.T @ y, w.T @ w, size])

        found = added(rows.select("trace"), sums)
        wy, ww, energy = found[:, :frames], found[:, frames:-1], float(found[0, -1])
        h = descended(h.T, wy.T, ww).T if exact else np.maximum(np.linalg.pinv(ww) @ wy, 0.0)
        errors.append(max(energy - 2 * float((wy * h).sum()) + float((ww * (h @ h.T)).sum()), 0.0))
        if exact and len(errors) > 1 and errors[-2] - errors[-1] <= tol * errors[-2]:
            break
    return weight_rows(rows, h, exact), h, errors


class Product:
    """The product of ``foot (k, px, a)`` and packed traces (``k, trace``), never formed: passes from numbers of components to pixels and back.

    Entries are packed once, a compressed string a block of pixels, and stay where they lie; a pass takes the components' numbers to
    the tasks and brings one row a component and task back. Beyond NORM_BYTES of numbers entries meet them by joins.
    """

    def __init__(self, foot: DataFrame, traces: DataFrame, count: int):
        self.joined = traces.count() * 8 * (count + 1) > NORM_BYTES

        def pack(table: pa.Table) -> pa.Table:
            k, px, a = (table.column(c).to_numpy() for c in ("k", "px", "a"))
            order = np.lexsort((k, px))
            data = packed_bytes(k[order], px[order], a[order])
            return pa.table({"pixels": [len(np.unique(px))], "size": [24 * len(k) + 24], "data": [data]})

        if self.joined:
            self.foot = cut(foot)
            self.pixels = self.foot.select("px").distinct().count()
            keys = self.foot.select("k")
        else:
            block = F.floor(F.col("px") / BLOCK_PIXELS)
            self.tiles = cut(foot.where("k is not null and px is not null").groupBy(block.alias("block")).applyInArrow(lambda _, d: pack(d.select(["k", "px", "a"])), "pixels long, size long, data binary"))
            self.pixels = self.tiles.agg(F.sum("pixels")).first()[0] or 0
            keys = self.sums()
        self.packed = cut(traces.join(keys.select("k").distinct(), "k", "left_semi"))

    def sums(self) -> DataFrame:
        """``k, s``: sums of a component's entries, a row a tile."""

        def run(batches):
            for batch in batches:
                for n, data in zip(batch.column("size").to_pylist(), batch.column("data"), strict=True):
                    k, _, a = unpacked_bytes(data.as_py(), n, [np.int64, np.int64, np.float64])
                    keys, at = np.unique(k, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(at, a, len(keys)))], ["k", "s"])

        return self.tiles.select("size", "data").mapInArrow(run, "k long, s double")

    def back(self, small: DataFrame) -> np.ndarray:
        """m'C of ``small (k, m)``."""
        return added(self.packed.join(small, "k").select("trace", "m"), lambda batch: matrix(batch.column("m"), batch.num_rows).T @ matrix(batch.column("trace"), batch.num_rows))

    def numbers(self, v: np.ndarray) -> DataFrame:
        """``k, m``: C v."""

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(list(matrix(batch.column("trace"), batch.num_rows) @ v), pa.list_(pa.float64()))], ["k", "m"])

        return self.packed.mapInArrow(run, "k long, m array<double>")

    def mixed(self, rows: DataFrame, size: int, key: str) -> DataFrame:
        """Sums of a m over ``rows (key, a, m)``, in plain aggregates."""
        d = rows.groupBy(key).agg(*(F.sum(F.col("a") * F.col("m")[i]).alias(f"s{i}") for i in range(size)))
        return d.select(key, F.array(*(f"s{i}" for i in range(size))).alias("m"))

    def images(self, v: np.ndarray, positive: bool) -> tuple:
        """(``px, w``: A C v, negative ones set to zero if ``positive``; what a tile needs for them)."""
        own, size = self.numbers(v), v.shape[1]
        if self.joined:
            w = self.mixed(self.foot.join(own, "k"), size, "px")
            return w.select("px", (F.transform("m", lambda x: F.greatest(x, F.lit(0.0))) if positive else F.col("m")).alias("w")), None
        table = own.toArrow().sort_by("k")  # some numbers a component
        ids, m = table.column("k").to_numpy(), matrix(table.column("m"), table.num_rows)

        def tile(size: int, data: bytes) -> tuple:
            k, px, a = unpacked_bytes(data, size, [np.int64, np.int64, np.float64])
            place = np.minimum(np.searchsorted(ids, k), len(ids) - 1)
            known = ids[place] == k
            cells, row = np.unique(px[known], return_inverse=True)
            w = sparse_times(row, len(cells), place[known], a[known], m)
            return place[known], row, a[known], cells, np.maximum(w, 0.0) if positive else w

        def run(batches):
            for batch in batches:
                for size, data in zip(batch.column("size").to_pylist(), batch.column("data"), strict=True):
                    _, _, _, cells, w = tile(size, data.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), lists(w)], ["px", "w"])

        return self.tiles.select("size", "data").mapInArrow(run, "px long, w array<double>"), (ids, tile)

    def turned(self, v: np.ndarray, positive: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(W'A C, W'W, squared norms of the positive and the negative parts of W) of the images W."""
        w, small = self.images(v, positive)
        size = v.shape[1]
        if self.joined:
            w = cut(w)
            squares = added(w.select("w"), lambda batch: (lambda x: np.vstack([x.T @ x, (np.maximum(x, 0.0) ** 2).sum(axis=0), (np.maximum(-x, 0.0) ** 2).sum(axis=0)]))(matrix(batch.column("w"), batch.num_rows)))
            return self.back(self.mixed(self.foot.join(w.withColumnRenamed("w", "m"), "px"), size, "k")), squares[:size], squares[size:]
        ids, tile = small

        def run(batches):
            sums, squares, met = np.zeros((len(ids), size)), np.zeros((size + 2, size)), np.zeros(len(ids), bool)
            for batch in batches:
                for n, data in zip(batch.column("size").to_pylist(), batch.column("data"), strict=True):
                    place, row, a, _, w = tile(n, data.as_py())
                    keys, at = np.unique(place, return_inverse=True)
                    sums[keys] += sparse_times(at, len(keys), row, a, w)
                    met[keys] = True
                    squares += np.vstack([w.T @ w, (np.maximum(w, 0.0) ** 2).sum(axis=0), (np.maximum(-w, 0.0) ** 2).sum(axis=0)])
            of = np.append(np.zeros(met.sum(), np.int32), np.ones(len(squares), np.int32))
            x = np.vstack([sums[met], squares])
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.append(ids[met], np.arange(len(squares)))), *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(size))], ["of", "k", *(f"s{i}" for i in range(size))])

        d = self.tiles.select("size", "data").mapInArrow(run, "of int, k long, " + ", ".join(f"s{i} double" for i in range(size)))
        d = cut(d.groupBy("of", "k").agg(F.array(*(F.sum(f"s{i}") for i in range(size))).alias("m")))
        squares = np.stack([r["m"] for r in d.where("of = 1").orderBy("k").collect()])
        return self.back(d.where("of = 0").select("k", "m")), squares[:size], squares[size:]

    def total(self) -> float:
        """Sum over the whole product."""
        d = self.foot.select("k", F.col("a").alias("s")) if self.joined else self.sums()
        return float(self.back(d.groupBy("k").agg(F.array(F.sum("s")).alias("m"))).sum())


def product_factors(foot: DataFrame, traces: DataFrame, count: int, rounds: int = 20, start: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """(``px, w``, H): the same fit (als) of the product of ``foot (k, px, w)`` and ``traces (k, c)``, which is never formed.

    What travels are vectors of ``count`` numbers a component or pixel.
    """
    foot = foot.select(F.col("k").cast("long"), F.col("px").cast("long"), F.col("w").cast("double").alias("a"))
    product = Product(foot, traces.select(F.col("k").cast("long"), F.col("c").alias("trace")), count)
    frames = frames_of(product.packed)
    if not frames:
        return foot.select("px", F.array().cast("array<double>").alias("w")).limit(0), np.zeros((count, 0))

    def first() -> np.ndarray:
        v = np.linalg.qr(np.random.Generator(np.random.PCG64(0)).normal(size=(frames, min(count, frames))))[0]
        for _ in range(8):
            v = np.linalg.qr(product.turned(v)[0].T)[0]
        values, turn = np.linalg.eigh(v.T @ product.turned(v)[0].T)
        v, s = v @ turn[:, ::-1], np.sqrt(np.maximum(values[::-1], 0.0))
        energy = product.turned(v)[2] / np.maximum(s, 1e-300) ** 2
        return signed_start(v, s, *energy, product.total() / (product.pixels * frames))

    h = first() if start is None else np.asarray(start, float)
    weights_of = lambda h: h.T @ np.linalg.pinv(h @ h.T)
    v = weights_of(h)
    for _ in range(rounds):
        v = weights_of(h)
        wb, ww, _ = product.turned(v, positive=True)
        h = np.maximum(np.linalg.pinv(ww) @ wb, 0.0)
    return product.images(v, True)[0], h


def splines(frames: int, knots: int) -> np.ndarray:
    """Cubic B-splines over ``frames`` samples on ``knots`` even knots, ends repeated; each row sums to one."""
    x = np.arange(frames, dtype=float)
    inner = np.linspace(0, max(frames - 1, 1), max(knots, 2))
    t = np.concatenate([[inner[0]] * 3, inner, [inner[-1]] * 3])
    out = ((x[:, None] >= t[None, :-1]) & (x[:, None] < t[None, 1:])).astype(float)
    out[x >= t[-1], len(t) - 5] = 1.0
    for degree in range(1, 4):
        left, right = t[degree:-1] - t[: -degree - 1], t[degree + 1 :] - t[1:-degree]
        a = np.divide(x[:, None] - t[None, : -degree - 1], left, out=np.zeros((frames, len(left))), where=left > 0)
        b = np.divide(t[None, degree + 1 :] - x[:, None], right, out=np.zeros((frames, len(right))), where=right > 0)
        out = a * out[:, :-1] + b * out[:, 1:]
    return out


def projections(rows: DataFrame, f: np.ndarray) -> DataFrame:
    """``px, w``: Y f' of every pixel (``f``: factors by frames)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("px"), pa.array(list(matrix(batch.column("trace"), batch.num_rows) @ f.T), pa.list_(pa.float64()))], ["px", "w"])

    return rows.select("px", "trace").mapInArrow(run, "px long, w array<double>")


def median_images(images: DataFrame, half: int) -> DataFrame:
    """``px, w``: medians over squares of half width ``half`` of each image of packed ``px, r, c, w``, zeros beyond the field; by tiles with a margin."""

    def run(key, table):
        r, c, px = (table.column(x).to_numpy() for x in ("r", "c", "px"))
        w = matrix(table.column("w"), len(px))
        field = np.zeros((TILE + 4 * half, TILE + 4 * half, w.shape[1]))
        row, column = r - key[0].as_py() * TILE, c - key[1].as_py() * TILE
        field[row + 2 * half, column + 2 * half] = w
        own = np.flatnonzero((row >= 0) & (row < TILE) & (column >= 0) & (column < TILE))
        near = np.lib.stride_tricks.sliding_window_view(field, (2 * half + 1, 2 * half + 1), axis=(0, 1))[row[own] + half, column[own] + half]
        out = list(np.median(near, axis=(2, 3))) if len(own) else []
        return pa.table({"px": px[own], "w": pa.array(out, pa.list_(pa.float64()))})

    return tiles(images, half).groupBy("tr", "tc").applyInArrow(run, "px long, w array<double>")


def background_model(pixels: DataFrame, model: str = "nmf", rank: int = 1, rounds: int = 20, rate: float = 5.0, size: int = 9) -> tuple[DataFrame, np.ndarray]:
    """(``px, w``, f): spatial and temporal factors of a background movie ``px, r, c, trace``; their product is the background.

    ``model``: nmf, non-negative factors; svd, the leading singular vectors; low_pass, cubic
    splines of slow change (a knot per 100 seconds at ``rate`` frames a second) and
    singular vectors of what they leave, whose images are smoothed by a median over
    squares of about half ``size``. Without pixels f has no frames.
    """
    frames = frames_of(pixels)
    if not frames:
        return pixels.select("px", F.array().cast("array<double>").alias("w")), np.zeros((rank, 0))
    if model == "nmf":
        w, f, _ = nonnegative_factors(pixels, rank, rounds)
        return w, f
    if model == "svd":
        f = leading_factors(pixels, rank)[2].T
        return projections(pixels, f), f
    if model != "low_pass":
        raise ValueError(f"no background model {model}")
    x = splines(frames, int(np.ceil(frames / 100 / rate)))
    fit = np.linalg.pinv(x)  # Y fit' are the splines' weights

    def left(batches):
        for batch in batches:
            if batch.num_rows:
                y = matrix(batch.column("trace"), batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column("px"), pa.array(list(y - y @ fit.T @ x.T), pa.list_(pa.float64()))], ["px", "trace"])

    rest = pixels.select("px", "trace").mapInArrow(left, "px long, trace array<double>")
    f = leading_factors(rest, rank)[2].T
    slow, fast = projections(pixels, fit), projections(rest, f)
    d = median_images(pixels.select("px", F.col("r").cast("int"), F.col("c").cast("int")).join(fast, "px"), max((int(size / 2 + 0.5) - 1) // 2, 0))
    return slow.withColumnRenamed("w", "slow").join(d, "px").select("px", F.concat("slow", "w").alias("w")), np.vstack([x.T, f])


def background_movie(w: DataFrame, f: np.ndarray) -> DataFrame:
    """``px, trace``: the product of the factors."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("px"), pa.array(list(matrix(batch.column("w"), batch.num_rows) @ f), pa.list_(pa.float64()))], ["px", "trace"])

    return w.mapInArrow(run, "px long, trace array<double>")
