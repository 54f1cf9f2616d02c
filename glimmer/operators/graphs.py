"""Merging and matching of components: graphs over footprints and traces."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import correlation
from ..plans.lineage import cut, ranked_by
from .linalg import SPREAD_TASKS, TASK_PAIRS, cosine_edges


def correlated_edges(foot: DataFrame, traces: DataFrame, overlap: float, least: float) -> DataFrame:
    """``k1 < k2, rho`` of pairs that overlap in space and correlate in time; constant traces correlate with none."""
    d = cosine_edges(foot, overlap).select("k1", "k2")
    for i in "12":
        d = d.join(traces.select(F.col("k").alias(f"k{i}"), F.col("c").alias(f"c{i}")), f"k{i}")
    return d.select("k1", "k2", correlation(F.col("c1"), F.col("c2")).alias("rho")).where(F.col("rho") >= least)


def merge_groups(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``k, component``: least k reachable, for every k with an edge to another one.

    A round links the larger neighbours of each node to the least node of its neighbourhood, then the smaller ones, until only stars
    are left: rounds grow with the logarithm of the nodes, also along a chain.
    """
    now = cut(edges.where("k1 <> k2").select(F.greatest("k1", "k2").alias("a"), F.least("k1", "k2").alias("b")).distinct())
    contents = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        now = cut(large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct())
        before, contents = contents, now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if contents == before:
            return now.select(F.col("a").alias("k"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
    raise RuntimeError("components did not settle")


def merge_scores(edges: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """``component, score, size, rank`` of the ``most`` groups with the largest summed correlation."""
    size = groups.groupBy("component").agg(F.count("*").alias("size"))
    d = edges.join(groups.select(F.col("k").alias("k1"), "component"), "k1").groupBy("component").agg(F.sum("rho").alias("score")).join(size, "component")
    return ranked_by(d.orderBy(F.desc(F.round("score", 9)), "component").limit(most), F.desc(F.round("score", 9)), "component")


def thresholded(foot: DataFrame, share: float) -> DataFrame:
    """Pixels of at least ``share`` of their footprint's maximum."""
    return foot.withColumn("top", F.max("w").over(Window.partitionBy("k"))).where(F.col("w") >= share * F.col("top")).select("k", "px")


def masks_by_pixel(first: DataFrame, second: DataFrame) -> DataFrame:
    """``px, k1, n1, k2, n2`` (arrays, in the order of k) of each pixel that both sides hold: its components and their numbers of rows."""
    sides = []
    for i, d in (("1", first), ("2", second)):
        own = F.struct(F.col("k").cast("long").alias("k"), F.count("*").over(Window.partitionBy("k")).cast("int").alias("n"))
        sides.append(d.where("k is not null").select("px", *(own.alias(f"e{j}") if i == j else F.lit(None).cast("struct<k:bigint,n:int>").alias(f"e{j}") for j in "12")).where("px is not null"))
    packed = sides[0].union(sides[1]).groupBy("px").agg(*(F.array_sort(F.collect_list(e)).alias(e) for e in ("e1", "e2"))).where("size(e1) > 0 and size(e2) > 0")
    return packed.select("px", F.col("e1.k").alias("k1"), F.col("e1.n").alias("n1"), F.col("e2.k").alias("k2"), F.col("e2.n").alias("n2"))


def session_distances(first: DataFrame, second: DataFrame, exponent: float, contained: float, most: float) -> DataFrame:
    """``k1, k2, d``: 1 - (shared / joint)^exponent of two sessions' masks (``k, px``); 0 where the smaller one is ``contained``.

    Pairs that share no pixel, or lie beyond ``most``, are impossible and have no row. Pairs are counted by ranges of k1, about
    TASK_PAIRS shared pixels a task, where they arise; impossible ones are dropped there, so they are no rows and not shuffled.
    """
    import numpy as np
    import pyarrow as pa

    packed = cut(masks_by_pixel(first, second))
    pairs = packed.agg(F.sum(F.size("k1").cast("double") * F.size("k2"))).first()[0] or 0.0
    tasks = min(1 << 14, math.ceil(pairs / TASK_PAIRS))
    bounds = np.zeros(0, np.int64)
    if tasks > 1:
        shares = [i / tasks for i in range(1, tasks)]
        bounds = np.unique(packed.select(F.explode("k1").alias("k")).agg(F.percentile_approx("k", shares, 10 * tasks)).first()[0])  # a number a task

    def spread(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = {c: batch.column(c).flatten() for c in ("k1", "n1", "k2", "n2")}
            length, other = (batch.column(c).value_lengths().to_numpy().astype(np.int64) for c in ("k1", "k2"))
            row, block = np.repeat(np.arange(batch.num_rows), length), np.searchsorted(bounds, flat["k1"].to_numpy())
            heads = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(block) != 0)))
            ends, of = np.append(heads[1:], len(row)), row[heads]
            start = np.cumsum(other) - other
            for part in np.split(np.arange(len(heads)), np.flatnonzero(np.diff(np.cumsum(ends - heads + other[of]) >> 20)) + 1):
                out = [pa.array(block[heads[part]])]
                for names, begin, size in ((("k1", "n1"), heads[part], (ends - heads)[part]), (("k2", "n2"), start[of[part]], other[of[part]])):
                    offsets = np.append(0, np.cumsum(size))
                    at = pa.array(np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size))
                    out += [pa.ListArray.from_arrays(offsets.astype(np.int32), flat[c].take(at)) for c in names]
                yield pa.RecordBatch.from_arrays(out, ["block", "k1", "n1", "k2", "n2"])

    def possible(table: pa.Table) -> pa.Table:
        sizes = [table.column(c).combine_chunks().value_lengths().to_numpy().astype(np.int64) for c in ("k1", "k2")]
        k1, n1, k2, n2 = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("k1", "n1", "k2", "n2"))
        (own1, first1, code1), (own2, first2, code2) = (np.unique(k, return_index=True, return_inverse=True) for k in (k1, k2))
        n1, n2 = n1[first1].astype(np.int64), n2[first2].astype(np.int64)
        row = np.repeat(np.arange(table.num_rows), sizes[0])
        width, start = sizes[1][row], (np.cumsum(sizes[1]) - sizes[1])[row]  # of each entry of k1: the entries of k2 that it meets
        sums: list[tuple] = []
        added = lambda cell, n: (lambda c, i: (c, np.bincount(i, n, len(c)) if n is not None else np.bincount(i, minlength=len(c))))(*np.unique(cell, return_inverse=True))
        for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(np.cumsum(width) // TASK_PAIRS)) + 1):
            w = width[part]
            j = np.arange(w.sum()) + np.repeat(start[part] - (np.cumsum(w) - w), w)
            sums.append(added(np.repeat(code1[part] * len(own2), w) + code2[j], None))
            if len(sums) > 8:
                sums = [added(*(np.concatenate(x) for x in zip(*sums, strict=True)))]
        cell, n = sums[0] if len(sums) == 1 else added(*(np.concatenate(x) for x in zip(*sums, strict=True)))
        i, j = np.divmod(cell, max(len(own2), 1))
        near = 1 - (n / (n1[i] + n2[j] - n)) ** exponent <= most + 1e-9  # Spark decides at the border
        use = np.flatnonzero(near | (n >= contained * np.minimum(n1[i], n2[j])))
        i, j = i[use], j[use]
        return pa.table({"k1": own1[i], "k2": own2[j], "n": n[use].astype(np.int64), "n1": n1[i], "n2": n2[j]})

    packed = packed.repartition(math.ceil(tasks / SPREAD_TASKS), "px") if tasks > SPREAD_TASKS else packed  # what a task sends does not grow
    d = packed.mapInArrow(spread, "block long, k1 array<long>, n1 array<int>, k2 array<long>, n2 array<int>")
    d = d.repartition(tasks, "block") if tasks > 1 else d
    d = d.groupBy("block").applyInArrow(possible, "k1 long, k2 long, n long, n1 long, n2 long")
    iou = F.col("n") / (F.col("n1") + F.col("n2") - F.col("n"))
    value = F.when(F.col("n") >= contained * F.least("n1", "n2"), 0.0).otherwise(1 - F.pow(iou, F.lit(exponent)))
    return d.select("k1", "k2", value.alias("d")).where(F.col("d") <= most)


def nonmatched(masks: DataFrame, candidates: DataFrame, side: str) -> DataFrame:
    """Components of one session (``side``: k1 or k2) without a candidate in the other."""
    return masks.select("k").distinct().join(candidates.select(F.col(side).alias("k")).distinct(), "k", "left_anti")


def hungarian(cost) -> list[tuple[int, int]]:
    """Assignment of least cost of a numpy matrix with ``inf`` for impossible pairs: most pairs first, then least sum."""
    import numpy as np

    n, m = cost.shape
    size = max(n, m)
    big = 1 + np.where(np.isfinite(cost), np.abs(cost), 0).sum() * 2
    full = np.full((size + 1, size + 1), big)
    full[1 : n + 1, 1 : m + 1] = np.where(np.isfinite(cost), cost, big)
    u, v, match = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, int)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(size + 1, np.inf), np.zeros(size + 1, bool), np.zeros(size + 1, int)
        while True:
            used[j0] = True
            row = match[j0]
            free = ~used
            free[0] = False
            own = full[row] - u[row] - v
            better = free & (own < least)
            least[better], way[better] = own[better], j0
            j1 = int(np.where(free, least, np.inf).argmin())
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            match[j0], j0 = match[j1], j1
    return [(match[j] - 1, j - 1) for j in range(1, size + 1) if match[j] <= n and j <= m and np.isfinite(cost[match[j] - 1, j - 1])]


def assignment(candidates: DataFrame) -> DataFrame:
    """``k1, k2, d`` of the best one-to-one matching of candidate pairs, solved per connected component of the candidates."""
    import numpy as np
    import pandas as pd

    candidates = cut(candidates)  # read three times
    edges = candidates.select((F.col("k1") * 2).alias("k1"), (F.col("k2") * 2 + 1).alias("k2"))
    groups = merge_groups(edges).where("k % 2 = 0").select((F.col("k") / 2).cast("long").alias("k1"), "component")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = np.unique(pdf.k1), np.unique(pdf.k2)
        cost = np.full((len(rows), len(cols)), np.inf)
        cost[np.searchsorted(rows, pdf.k1), np.searchsorted(cols, pdf.k2)] = pdf.d
        pairs = hungarian(cost)
        return pd.DataFrame({"k1": [rows[i] for i, _ in pairs], "k2": [cols[j] for _, j in pairs], "d": [cost[i, j] for i, j in pairs]}).astype({"k1": "int64", "k2": "int64", "d": "float64"})

    return candidates.join(groups, "k1").groupBy("component").applyInPandas(solve, "k1 long, k2 long, d double")
