"""Updates of a factorisation Y = A C + b f over packed pixels (``px, r, c, trace``), sparse footprints and packed traces.

Products over pixels are sums of whole vectors; what couples components is their
Gram matrix, which is as sparse as their overlaps.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .factors import nonnegative_factors, weight_rows
from .graphs import merge_groups
from .linalg import block_residuals, gram, product_ay, weighted_sums
from .numerics import soft_hals
from .spatial import pixel_weights, positive


#: Edges between components that one task puts in order, on average.
ORDER_EDGES = 1 << 21


def update_order(overlaps: DataFrame, components: DataFrame, edges: int = ORDER_EDGES) -> DataFrame:
    """``k, step``: components of one step share no pixel, so they can be updated at once.

    ``overlaps``: k1, k2 (both orders, k1 <> k2); ``components``: k. Each component takes the
    least step that none of its neighbours of higher rank (by hash) has. Ranks are cut into ranges, of which each in its
    turn gets the steps that ranges before it took, by a join, and is put in order by one task. Ranges are
    so many that ``edges`` lie inside of one: their number grows with the root of the edges, not with the longest chain of neighbours.
    """
    rank = lambda k: F.struct(F.xxhash64(k).alias("h"), F.col(k))
    before = cut(overlaps.where(rank("k2") < rank("k1")).select(F.col("k1").cast("long"), F.col("k2").cast("long")).distinct())
    every = cut(components.select(F.col("k").cast("long")).distinct())
    ranges = max(1, math.ceil(math.sqrt(before.count() / edges)))
    part = lambda k: F.least(F.floor((F.xxhash64(k).cast("double") + 2.0**63) / 2.0**64 * ranges), F.lit(ranges - 1))
    done = []

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.sort(pdf.k.to_numpy())
        step = np.full(len(keys), -1)
        for k, near, taken in pdf.sort_values(["h", "k"])[["k", "near", "taken"]].itertuples(index=False):
            own = np.concatenate([step[np.searchsorted(keys, np.asarray(near, np.int64))], np.asarray(taken, np.int64)])
            free = np.ones(len(own) + 1, bool)
            free[own[own < len(free)]] = False
            step[np.searchsorted(keys, k)] = free.argmax()
        return pd.DataFrame({"k": keys, "step": step.astype(np.int32)})

    for i in range(ranges):
        own = before.where(part("k1") == i)
        d = every.where(part("k") == i).join(own.where(part("k2") == i).groupBy(F.col("k1").alias("k")).agg(F.collect_list("k2").alias("near")), "k", "left")
        none = F.array()
        taken = F.lit(None).cast("array<int>")
        if done:
            earlier = functools.reduce(DataFrame.union, done).withColumnRenamed("k", "k2")
            d = d.join(own.where(part("k2") < i).join(earlier, "k2").groupBy(F.col("k1").alias("k")).agg(F.collect_set("step").alias("taken")), "k", "left")
            taken = F.col("taken")
        d = d.select("k", F.xxhash64("k").alias("h"), F.coalesce("near", none.cast("array<long>")).alias("near"), F.coalesce(taken, none.cast("array<int>")).alias("taken"))
        done.append(cut(d.withColumn("range", F.lit(i)).groupBy("range").applyInPandas(ordered, "k long, step int")))
    return functools.reduce(DataFrame.union, done)


def corrected(ay: DataFrame, grams: DataFrame, traces: DataFrame) -> DataFrame:
    """``k, c``: c + (A'Y - A'A C) / |a|^2, the least-squares trace of each component with the others fixed."""
    ac = weighted_sums(grams.join(traces.select(F.col("k").alias("k2"), "c"), "k2").select(F.col("k1").alias("k"), F.col("v").alias("w"), F.col("c").alias("x")))
    norm = grams.where("k1 = k2").select(F.col("k1").alias("k"), F.col("v").alias("norm"))
    d = traces.select("k", "c").join(norm, "k").join(ay.select("k", "ay"), "k").join(ac.select("k", F.col("x").alias("ac")), "k")
    d = d.select("k", "norm", "c", F.zip_with("ay", "ac", lambda x, y: x - y).alias("left"))
    return d.select("k", F.zip_with("c", "left", lambda x, y: x + y / F.col("norm")).alias("c"))


def least_squares_step(foot: DataFrame, pixels: DataFrame, traces: DataFrame) -> DataFrame:
    """``k, c``: the same for all components at once, without A'A: what A C leaves of the movie is formed by blocks of pixels."""
    d = traces.select("k", "c").join(block_residuals(foot, pixels, traces), "k")
    return d.select("k", F.zip_with("c", "x", lambda c, x: c + x / F.col("norm")).alias("c"))


#: Bytes of a block of components that meet in pixels, from which it is swept in parts, one after the other, and of what one task sweeps on average.
BLOCK_BYTES, TASK_BYTES = 64 << 20, 8 << 20
#: Steps of the update order up to which each of them is a part that many tasks share; of more steps some make up a part.
PART_STEPS = 64


def neighbours(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, places, products) of the neighbours of each row that have a row themselves; rows: k (ascending), near, v."""
    keys = block.k.to_numpy()
    size = np.array([len(x) for x in block.near], int)
    near, v = (np.concatenate([np.zeros(0), *block[x]]) for x in ("near", "v"))
    row, near = np.repeat(np.arange(len(keys)), size), near.astype(np.int64)
    place = np.minimum(np.searchsorted(keys, near), len(keys) - 1)
    known = keys[place] == near
    return np.append(0, np.cumsum(np.bincount(row[known], minlength=len(keys)))), place[known], v[known]


def swept(block: pd.DataFrame, sweeps: int, tol: float, shape: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Traces of one block after its sweeps, in the steps of ``update_order``; rows: rank, k (ascending), c, ay, near (neighbours), v (their products, the own one included)."""
    ends, place, v = neighbours(block)
    steps = np.full(len(block), -1)
    order = np.lexsort((block.k.to_numpy(), block["rank"].to_numpy()))
    for i in order.tolist():
        taken = steps[place[ends[i] : ends[i + 1]]]
        free = np.ones(len(taken) + 1, bool)
        free[taken[(taken >= 0) & (taken < len(free))]] = False
        steps[i] = free.argmax()
    own = place == np.repeat(np.arange(len(block)), np.diff(ends))
    norm = np.bincount(place[own], v[own], len(block))
    c, ay = np.stack(block.c.to_numpy()).astype(float), np.stack(block.ay.to_numpy()).astype(float)
    for _ in range(sweeps):
        before = c.copy()
        for i in np.argsort(steps, kind="stable").tolist():
            near = slice(ends[i], ends[i + 1])
            c[i] = shape(c[i] + (ay[i] - v[near] @ c[place[near]]) / norm[i])
        if ((c - before) ** 2).sum() <= tol * tol * (before**2).sum():
            break
    return c


def temporal_hals(foot: DataFrame, pixels: DataFrame, traces: DataFrame, sweeps: int = 1, tol: float = 1e-4, shape: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``k, c``: block coordinate descent on the traces, footprints fixed.

    Components that meet in pixels, directly or through others, form a block. A block
    is gathered with its Gram matrix and A'Y and swept in one task; where it is too large for
    that (BLOCK_BYTES), it is swept in parts of the update order.
    A block stops where a sweep moves it by less than ``tol`` of its norm. ``shape`` maps a least-squares trace to the one that is
    kept, such as its deconvolution; without it negative samples become zero.
    Components without a footprint or on pixels that the movie lacks stay as they are.
    """
    shape = shape or (lambda y: np.maximum(y, 0.0))
    traces = traces.select(F.col("k").cast("long"), "c")
    own = foot.where("w <> 0").select(F.col("k").cast("long"), F.col("px").cast("long"), F.col("w").cast("double"))
    own = cut(own.join(pixels.select("px"), "px", "left_semi").join(traces.select("k"), "k", "left_semi"))
    first = own.groupBy("px").agg(F.min("k").alias("k1"))
    blocks = merge_groups(own.join(first, "px").select("k1", F.col("k").alias("k2")))
    g = cut(gram(own).where("v <> 0 or k1 = k2").select("k1", "k2", "v"))
    d = g.groupBy(F.col("k1").alias("k")).agg(F.count("*").alias("n")).join(blocks, "k", "left")
    d = cut(d.join(traces.select("k", F.size("c").alias("frames")), "k").select("k", F.coalesce("component", "k").alias("block"), (16 * (F.col("frames") + F.col("n"))).alias("bytes")))
    size = cut(d.groupBy("block").agg(F.sum("bytes").alias("bytes")))
    total, most = size.agg(F.sum("bytes"), F.max("bytes")).first()
    parts = [traces.join(d.select("k"), "k", "left_anti")]
    if total is not None and size.where(F.col("bytes") <= BLOCK_BYTES).limit(1).count():
        rows, members = g, d
        if most > BLOCK_BYTES:
            members = d.join(size.where(F.col("bytes") <= BLOCK_BYTES).select("block"), "block", "left_semi")
            rows = g.join(members.select(F.col("k").alias("k1")), "k1", "left_semi")
        near = rows.groupBy(F.col("k1").alias("k")).agg(F.collect_list("k2").alias("near"), F.collect_list("v").alias("v"))  # a component's neighbours
        small = members.select("block", "k").join(traces, "k").join(near, "k").join(product_ay(own, pixels), "k").withColumn("rank", F.xxhash64("k"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"k": own.k, "c": list(swept(own, sweeps, tol, shape))}) for _, own in pdf.sort_values("k").groupby("block")]
            return pd.concat(out)[["k", "c"]]

        task = F.pmod(F.xxhash64("block"), F.lit(max(1, int(total) // TASK_BYTES)))
        parts.append(small.withColumn("task", task).groupBy("task").applyInPandas(run, "k long, c array<double>"))
    if total is not None and most > BLOCK_BYTES:
        large = cut(d.join(size.where(F.col("bytes") > BLOCK_BYTES).select("block"), "block", "left_semi").select("k", "bytes"))
        parts.append(swept_in_parts(large, own, pixels, traces, g, sweeps, tol, shape))
    return cut(functools.reduce(DataFrame.union, parts))


def swept_in_parts(members: DataFrame, foot: DataFrame, pixels: DataFrame, traces: DataFrame, g: DataFrame, sweeps: int, tol: float, shape: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``k, c``: the same of blocks that no task holds (``members``: k, bytes), part after part of the update order.

    A part is one step, whose components share no pixel and are dealt to tasks, or, of many steps, some that follow one another and hold
    about ORDER_EDGES pairs among them, which one task sweeps. What the traces so far leave of the movie is formed by blocks
    of pixels, so a part sends no pair but its own ones: parts grow with the root of the pairs.
    """
    edges = g.where("k1 <> k2").join(members.select(F.col("k").alias("k1")), "k1", "left_semi")
    order = cut(update_order(edges, members.select("k")).join(members, "k"))
    steps = order.groupBy("step").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).orderBy("step").collect()  # a row a step
    frames = traces.select(F.size("c")).first()[0]
    count = max(math.ceil(math.sqrt(edges.count() / 2 / ORDER_EDGES)), math.ceil(sum(s["n"] for s in steps) * frames * 16 / BLOCK_BYTES))
    count = len(steps) if len(steps) <= PART_STEPS else min(count, len(steps))
    while True:
        share = np.cumsum([s["bytes"] for s in steps]) / sum(s["bytes"] for s in steps)
        of = np.arange(len(steps)) if count == len(steps) else np.searchsorted(np.arange(1, count) / count, share)
        firsts = [i for i in range(1, len(of)) if of[i] != of[i - 1]]
        part = F.size(F.filter(F.array(*(F.lit(i) for i in firsts)).cast("array<int>"), lambda i: i <= F.col("step")))
        ordered = cut(order.select("k", "step", part.alias("part")))
        sides = [ordered.select(F.col("k").alias(f"k{i}"), F.col("part").alias(f"part{i}")) for i in (1, 2)]
        inner = cut(edges.join(sides[0], "k1").join(sides[1], "k2").where("part1 = part2").groupBy(F.col("k1").alias("k")).agg(F.collect_list("k2").alias("near"), F.collect_list("v").alias("v"), F.first("part1").alias("part")))
        pairs = {r["part"]: r["n"] / 2 for r in inner.groupBy("part").agg(F.sum(F.size("near")).alias("n")).collect()}  # a row a part
        if count == len(steps) or max(pairs.values(), default=0) <= 4 * ORDER_EDGES:
            break
        count = min(2 * count, len(steps))
    inner = inner.drop("part")
    held = cut(foot.join(ordered, "k").select("k", "px", "w", "part"))
    now = cut(traces.join(ordered.select("k"), "k", "left_semi"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        none = np.zeros(0)
        ends, place, v = neighbours(pdf.assign(**{x: [none if y is None else y for y in pdf[x]] for x in ("near", "v")}))
        c, x, norm = np.stack(pdf.c.to_numpy()).astype(float), np.stack(pdf.x.to_numpy()).astype(float), pdf.norm.to_numpy()
        moved = np.zeros_like(c)
        for i in np.argsort(pdf.step.to_numpy(), kind="stable").tolist():
            near = slice(ends[i], ends[i + 1])
            moved[i] = shape(c[i] + (x[i] - v[near] @ moved[place[near]]) / norm[i]) - c[i]
        return pd.DataFrame({"k": pdf.k.to_numpy(), "new": list(c + moved)})

    for sweep in range(sweeps):
        before = now
        for i in range(len(firsts) + 1):
            rows = ordered.where(F.col("part") == i).select("k", "step").join(block_residuals(held, pixels, now, F.col("part") == i), "k").join(now, "k").join(inner, "k", "left")
            tasks = 1 if pairs.get(i) else max(foot.sparkSession.sparkContext.defaultParallelism, math.ceil(sum(s["n"] for s in steps) * frames * 16 / TASK_BYTES))
            new = rows.groupBy(F.pmod(F.xxhash64("k"), F.lit(tasks))).applyInPandas(run, "k long, new array<double>")
            now = cut(now.join(new, "k", "left").select("k", F.coalesce("new", "c").alias("c")))
        if sweep < sweeps - 1:
            size = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
            moved = now.join(before.select("k", F.col("c").alias("old")), "k").agg(F.sum(size(F.zip_with("c", "old", lambda x, y: x - y))), F.sum(size(F.col("old")))).first()
            if moved[0] is None or moved[0] <= tol * tol * (moved[1] or 0.0):
                break
    return now


def search_locations(foot: DataFrame, rows: int, columns: int, radius: int = 4) -> DataFrame:
    """``k, px``: pixels within ``radius`` of a pixel of the footprint, inside the field. Each footprint by itself: a pixel's disk is no row."""
    disk = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]

    def one(table: pa.Table) -> pa.Table:
        px = table.column("px").to_numpy()
        c, r = np.divmod(px, rows)
        near = np.unique(np.concatenate([px[(r + a >= 0) & (r + a < rows) & (c + b >= 0) & (c + b < columns)] + b * rows + a for a, b in disk]))
        return pa.table({"k": pa.array([table.column("k")[0].as_py()] * len(near), pa.int64()), "px": pa.array(near, pa.int64())})

    d = foot.where("w > 0 and px is not null").select(F.col("k").cast("long"), F.col("px").cast("long"))
    return d.groupBy("k").applyInArrow(one, "k long, px long")


def ellipse_locations(foot: DataFrame, rows: int, columns: int, least: float = 3.0, most: float = 8.0, expand: float = 3.0) -> DataFrame:
    """``k, px``: pixels of the ellipse of a footprint's moments: axes of ``expand`` standard deviations, these held to ``least`` ... ``most``.

    Per component a few moments are summed; its ellipse is unrolled from a bounding box of bounded size.
    """
    r, c = (F.col("px") % rows).cast("double"), F.floor(F.col("px") / rows).cast("double")
    w = F.col("w")
    m = foot.where("w > 0").groupBy("k").agg(F.sum(w).alias("s"), F.sum(w * r).alias("r"), F.sum(w * c).alias("c"), F.sum(w * r * r).alias("rr"), F.sum(w * c * c).alias("cc"), F.sum(w * r * c).alias("rc"))
    m = m.select("k", (F.col("r") / F.col("s")).alias("r"), (F.col("c") / F.col("s")).alias("c"), "s", "rr", "cc", "rc")
    m = m.select("k", "r", "c", (F.col("rr") / F.col("s") - F.col("r") ** 2).alias("vr"), (F.col("cc") / F.col("s") - F.col("c") ** 2).alias("vc"), (F.col("rc") / F.col("s") - F.col("r") * F.col("c")).alias("vx"))
    half = F.sqrt(((F.col("vr") - F.col("vc")) / 2) ** 2 + F.col("vx") ** 2)
    m = m.withColumn("angle", F.atan2(2 * F.col("vx"), F.col("vr") - F.col("vc")) / 2)
    axis = lambda v: F.least(F.lit(most), F.greatest(F.lit(least), F.sqrt(F.greatest(v, F.lit(0.0)))))
    m = m.withColumn("p", axis((F.col("vr") + F.col("vc")) / 2 + half)).withColumn("q", axis((F.col("vr") + F.col("vc")) / 2 - half))
    reach = int(np.ceil(expand * most))
    box = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    d = m.withColumn("a", box).withColumn("b", box)
    d = d.withColumn("y", F.round("r") + F.col("a")).withColumn("x", F.round("c") + F.col("b")).where((F.col("y") >= 0) & (F.col("y") < rows) & (F.col("x") >= 0) & (F.col("x") < columns))
    dr, dc = F.col("y") - F.col("r"), F.col("x") - F.col("c")
    u, z = dr * F.cos("angle") + dc * F.sin("angle"), dc * F.cos("angle") - dr * F.sin("angle")
    inside = (u / F.col("p")) ** 2 + (z / F.col("q")) ** 2 <= expand * expand
    return d.where(inside).select("k", (F.col("x") * rows + F.col("y")).cast("long").alias("px"))


def update_spatial(pixels: DataFrame, candidates: DataFrame, traces: DataFrame, penalty: float = 0.6745, background: DataFrame | None = None) -> DataFrame:
    """``k, px, w`` > 0: each pixel's non-negative weights on its candidates' traces, soft-thresholded by its noise.

    ``candidates``: k, px; a pixel meets only these traces.
    ``pixels`` has ``px, trace, noise``; ``background (px, trace)`` is taken off first.
    The threshold of a trace is ``penalty`` * noise * its norm.
    """

    def solve(y, c, noise):
        return soft_hals(c @ y, c @ c.T, penalty * noise * np.sqrt((c * c).sum(axis=1)), np.ones(len(c), bool))

    return positive(pixel_weights(pixels, candidates, traces, solve, background))


def thresholded_footprints(foot: DataFrame, rows: int, energy: float = 0.9999, close: int = 1, median: int = 1, method: str = "energy", share: float = 0.25) -> DataFrame:
    """``k, px, w``: footprints smoothed by a median, cut to their energy or to a share of their maximum, closed, and cut to one connected piece.

    Each component by itself, on its own pixels and those that squares reach from them. ``median`` and
    ``close`` are half widths of squares. By energy the piece with most energy stays,
    by maximum the largest one; equal pieces by their first pixel. Closed holes keep
    the smoothed value, which may be zero.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf.px.to_numpy())
        a = pdf.w.to_numpy()[np.argsort(pdf.px.to_numpy(), kind="stable")]
        inside = lambda p: p[(p[:, 0] >= 0) & (p[:, 0] < rows) & (p[:, 1] >= 0)]
        cells = np.stack([at % rows, at // rows], axis=1)
        if median:
            near = inside(_widened(cells, median))
            cells, a = near, np.median(_looked_up(near[:, None] + _square(median), cells, a), axis=1)
        if method == "energy":
            # equal values by row, then column; cells of no value carry no energy
            order = np.lexsort((cells[:, 1], cells[:, 0], a))
            sums = np.cumsum(a[order] ** 2)
            own = order[int((sums > (1 - energy) * sums[-1]).argmax()) :] if sums[-1] > 0 else order[:0]
        else:
            a = np.where(a < share * a.max(), 0.0, a)
            own = np.flatnonzero(a > 0)
        mask = cells[own]
        if close and len(mask):
            wide = _widened(mask, close)
            codes, near = _codes(wide), inside(wide)
            for step in _square(close):  # what one step rules out is not looked at again
                at = _codes(near + step)
                near = near[codes[np.minimum(np.searchsorted(codes, at), len(codes) - 1)] == at]
            mask = near
        if not len(mask):
            return pdf.iloc[:0][["k", "px", "w"]]
        w = _looked_up(mask, cells, a)
        label = sparse_pieces(mask)
        size = np.bincount(label, w * w if method == "energy" else None)
        best = np.flatnonzero(label == int(size.argmax()))
        best = best[np.lexsort((mask[best, 1], mask[best, 0]))]
        return pd.DataFrame({"k": int(pdf.k.iloc[0]), "px": mask[best, 1] * rows + mask[best, 0], "w": w[best]})

    return foot.where("w > 0").select("k", "px", F.col("w").cast("double")).groupBy("k").applyInPandas(one, "k long, px long, w double").where("w > 0")


def trimmed_footprints(foot: DataFrame, rows: int, share: float = 0.01, half: int = 2, least: int = 5) -> DataFrame:
    """``k, px, w``: the four-connected piece around a footprint's peak after an opening by squares, where it exceeds ``share`` of the maximum.

    Footprints of fewer than ``least`` pixels after that are dropped.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf.px.to_numpy()
        cells, a = np.stack([at % rows, at // rows], axis=1), pdf.w.to_numpy()
        opened, o = cells, a
        if half:
            o = _looked_up(cells[:, None] + _square(half), cells, a).min(axis=1)
            opened = _widened(cells, half)
            o = _looked_up(opened[:, None] + _square(half), cells, o).max(axis=1)
        order = np.lexsort((opened[:, 1], opened[:, 0]))  # of equal peaks the first by row, then column
        peak = opened[order[int(o[order].argmax())]]
        mask = opened[o > share * a.max()]
        label = sparse_pieces(mask, corners=False)
        own = mask[label == label[(mask == peak).all(axis=1)][0]] if len(mask) and (mask == peak).all(axis=1).any() else mask[:0]
        w = _looked_up(own, cells, a)
        own, w = own[w > 0], w[w > 0]
        if len(own) < least:
            return pdf.iloc[:0][["k", "px", "w"]]
        order = np.lexsort((own[:, 1], own[:, 0]))
        return pd.DataFrame({"k": int(pdf.k.iloc[0]), "px": own[order, 1] * rows + own[order, 0], "w": w[order]})

    return foot.where("w > 0").select("k", "px", F.col("w").cast("double")).groupBy("k").applyInPandas(one, "k long, px long, w double")


def regressed_footprints(pixels: DataFrame, candidates: DataFrame, traces: DataFrame) -> DataFrame:
    """``k, px, w`` > 0: least-squares weights of each pixel on its candidates' traces (``candidates``: k, px), negative ones left out.

    Equal traces share their weight (the solution of least norm).
    """
    return positive(pixel_weights(pixels.select("px", "trace"), candidates, traces, lambda y, c, _: np.linalg.lstsq(c.T, y, rcond=None)[0]))


def regressed_traces(foot: DataFrame, pixels: DataFrame, rounds: int = 200, tol: float = 1e-10) -> DataFrame:
    """``k, c``: (A'A)^-1 A'Y, negative samples set to zero, by conjugate gradients on all traces at once.

    A round is one sparse product of the Gram matrix with packed vectors. Only
    components with pixels in the movie have a row.
    """
    g = cut(gram(foot.join(pixels.select("px"), "px", "left_semi")))
    now = product_ay(foot, pixels).select("k", F.transform("ay", lambda x: x * 0.0).alias("x"), F.col("ay").alias("r"), F.col("ay").alias("p"))
    now = cut(now)
    dots = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda u, x: u + x)
    rr = now.agg(F.sum(dots("r", "r"))).first()[0] or 0.0
    first = rr
    for _ in range(rounds):
        if rr <= tol * tol * first or not rr:
            break
        gp = weighted_sums(g.join(now.select(F.col("k").alias("k2"), "p"), "k2").select(F.col("k1").alias("k"), F.col("v").alias("w"), F.col("p").alias("x"))).select("k", F.col("x").alias("gp"))
        d = cut(now.join(gp, "k"))
        alpha = rr / d.agg(F.sum(dots("p", "gp"))).first()[0]
        d = d.select("k", F.zip_with("x", "p", lambda x, p: x + alpha * p).alias("x"), F.zip_with("r", "gp", lambda r, q: r - alpha * q).alias("r"), "p")
        d = cut(d)
        new = d.agg(F.sum(dots("r", "r"))).first()[0]
        beta, rr = new / rr, new
        now = d.select("k", "x", "r", F.zip_with("r", "p", lambda r, p: r + beta * p).alias("p"))
    else:
        raise RuntimeError("regressed_traces: the rounds ended before the tolerance")
    return now.select("k", F.transform("x", lambda x: F.greatest(x, F.lit(0.0))).alias("c"))


def contour_pixels(foot: DataFrame, rows: int, share: float) -> DataFrame:
    """``k, px``: pixels above ``share`` of their footprint's maximum that have a side neighbour which is not."""

    def one(table: pa.Table) -> pa.Table:
        px, w = table.column("px").to_numpy(), table.column("w").to_numpy()
        px = np.sort(px[w > share * w.max()])
        r, inner = px % rows, np.ones(len(px), bool)
        for step, inside in ((-1, r > 0), (1, r < rows - 1), (-rows, True), (rows, True)):
            at = np.minimum(np.searchsorted(px, px + step), len(px) - 1)
            inner &= (px[at] == px + step) & inside
        px = px[~inner]
        return pa.table({"k": pa.array([table.column("k")[0].as_py()] * len(px), pa.int64()), "px": pa.array(px, pa.int64())})

    d = foot.where("w is not null and px is not null").select(F.col("k").cast("long"), F.col("px").cast("long"), F.col("w").cast("double"))
    return d.groupBy("k").applyInArrow(one, "k long, px long")


def _square(half: int) -> np.ndarray:
    """Offsets of the cells of a square."""
    return np.stack(np.meshgrid(*[np.arange(-half, half + 1)] * 2, indexing="ij"), axis=-1).reshape(-1, 2)


def _codes(cells: np.ndarray) -> np.ndarray:
    """One number a cell (row, column), in column order; coordinates lie within 2^31."""
    return (cells[..., 1] << 32) + cells[..., 0]


def _widened(cells: np.ndarray, half: int) -> np.ndarray:
    """Cells that squares around ``cells`` cover."""
    near = (cells[:, None] + _square(half)).reshape(-1, 2)
    return near[np.unique(_codes(near), return_index=True)[1]]


def _looked_up(at: np.ndarray, cells: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of the cells ``at``, zero where ``cells`` lack them."""
    codes, order = _codes(at), np.argsort(_codes(cells))
    known = _codes(cells)[order]
    place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[place] == codes, values[order][place], 0.0)


def sparse_pieces(cells: np.ndarray, corners: bool = True) -> np.ndarray:
    """Labels 0, 1, ... of the connected pieces of cells, by their first cell in column order; ``corners`` connect as sides do.

    Roots are hooked under lesser neighbouring roots and paths halved until nothing moves: time follows the cells, not the box around them.
    """
    order = np.argsort(_codes(cells))
    known = _codes(cells)[order]
    i, j = [], []
    for step in (1, 1 << 32, *(((1 << 32) + 1, (1 << 32) - 1) if corners else ())):
        place = np.minimum(np.searchsorted(known, known + step), max(len(known) - 1, 0))
        hit = np.flatnonzero(known[place] == known + step)
        i.append(hit)
        j.append(place[hit])
    i, j = np.concatenate(i), np.concatenate(j)
    root = np.arange(len(known))
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    label = np.empty(len(known), int)
    label[order] = np.unique(root, return_inverse=True)[1]
    return label


def rank_one_background(pixels: DataFrame, rounds: int = 20, tol: float = 1e-9) -> tuple[DataFrame, np.ndarray]:
    """(``px, b``, f) of the non-negative rank-one fit of ``pixels``, from the mean frame intensities on.

    b belongs to the last f but one, which the round began with. An empty movie gives an empty table and no frames.
    """
    start = weighted_sums(pixels.select(F.lit(0).alias("k"), F.lit(1.0).alias("w"), F.col("trace").alias("x"))).collect()
    if not start:
        return pixels.select("px", F.lit(0.0).alias("b")), np.zeros(0)
    f = np.maximum(0.0, np.array(start[0]["x"]) / pixels.count())[None]
    if rounds > 1:
        f = nonnegative_factors(pixels, 1, rounds - 1, tol, start=f)[1]
    w = weight_rows(pixels, f, True)
    return w.select("px", F.col("w")[0].alias("b")), nonnegative_factors(pixels, 1, 1, start=f)[1][0]
