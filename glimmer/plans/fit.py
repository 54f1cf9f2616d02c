"""The factorisation pipeline: patches, noise, greedy start, refinement, merging and deconvolution."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import images, numerics, patches, seeds
from ..operators.components import residual_movie
from ..operators.factors import background_movie
from ..operators.graphs import assignment, correlated_edges, merge_groups, session_distances, thresholded
from ..operators.updates import rank_one_background, search_locations, temporal_hals, thresholded_footprints, update_spatial
from .lineage import cut, ranked_by


@dataclass(frozen=True)
class FitOptions:
    """Sizes in pixels and frames; ``components`` is per patch."""

    patch: int = 12
    overlap: int = 4
    least: int = 3
    components: int = 3
    radius: float = 2.0
    sweeps: int = 5
    merge_overlap: float = 0.3
    merge_rho: float = 0.8
    search: int = 4


def fit_patches(pixels: DataFrame, rows: int, columns: int, options: FitOptions = FitOptions()) -> DataFrame:
    """``patch, k, px (array), w (array), c (array)``: each patch is factorised by one grouped task on its own pixels."""
    grid = patches.patch_grid(pixels.sparkSession, rows, columns, options.patch, options.overlap, options.least)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("px")
        y = np.stack(pdf.trace.to_numpy()).astype(float)
        found = numerics.greedy_components(pdf[["r", "c"]].to_numpy(float), y, options.components, options.radius)
        if not found:
            return pd.DataFrame({"patch": [], "k": [], "px": [], "w": [], "c": []})
        a, c = np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found])
        a, c = numerics.hals(y - np.median(y, axis=1, keepdims=True), a, c, options.sweeps)
        patch = int(pdf.patch.iloc[0])
        keep = [k for k in range(a.shape[1]) if a[:, k].any() and c[k].any()]
        px = pdf.px.to_numpy()
        return pd.DataFrame({"patch": patch, "k": [(patch << 20) + k for k in keep], "px": [px[a[:, k] > 0].tolist() for k in keep], "w": [a[a[:, k] > 0, k].tolist() for k in keep], "c": [c[k].tolist() for k in keep]})

    return patches.by_patch(images.shifted(pixels), grid, run, "patch int, k long, px array<long>, w array<double>, c array<double>")


def start_seeded(pixels: DataFrame, rows: int, columns: int, options: FitOptions = FitOptions(), **how) -> DataFrame:
    """``patch, k, px, w, c``: seeds by local correlation and peak-to-noise in each patch, for movies with strong background.

    ``how``: ``size``, ``sigma`` and limits of ``seeds.seeded_components``.
    """
    grid = patches.patch_grid(pixels.sparkSession, rows, columns, options.patch, options.overlap, options.least)
    how = {"size": 7, "sigma": 1.5} | how

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = (pdf[x].to_numpy() for x in ("r", "c"))
        y = np.stack(pdf.trace.to_numpy()).astype(float)
        cube, number = np.zeros((r.max() - r.min() + 1, c.max() - c.min() + 1, y.shape[1])), np.full((r.max() - r.min() + 1, c.max() - c.min() + 1), -1)
        cube[r - r.min(), c - c.min()], number[r - r.min(), c - c.min()] = y, pdf.px.to_numpy()
        patch, out = int(pdf.patch.iloc[0]), []
        for k, (a, trace) in enumerate(seeds.seeded_components(cube, options.components, **how)):
            own = (a > 0) & (number >= 0)
            out.append((patch, (patch << 20) + k, number[own].tolist(), a[own].tolist(), trace.tolist()))
        return pd.DataFrame(out, columns=["patch", "k", "px", "w", "c"])

    return patches.by_patch(pixels, grid, run, "patch int, k long, px array<long>, w array<double>, c array<double>")


def merged(components: DataFrame, options: FitOptions = FitOptions()) -> DataFrame:
    """Components of all patches, those that overlap and correlate replaced by their rank-one fit; ``k`` is the least merged.

    ``members`` counts the components of patches behind each; a table without it has one each.
    """
    components = components if "members" in components.columns else components.withColumn("members", F.lit(1).cast("long"))
    foot = components.select("k", F.explode(F.arrays_zip("px", "w")).alias("x")).select("k", F.col("x.px").alias("px"), F.col("x.w").alias("w"))
    edges = correlated_edges(foot, components.select("k", "c"), options.merge_overlap, options.merge_rho)
    groups = merge_groups(edges)
    tagged = components.join(groups, "k", "left").withColumn("component", F.coalesce("component", "k"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        px = np.unique(np.concatenate(pdf.px.to_numpy()))
        a = np.zeros((len(px), len(pdf)))
        for i, (p, w) in enumerate(zip(pdf.px, pdf.w, strict=True)):
            a[np.searchsorted(px, p), i] = w
        foot, c = numerics.rank_one(a, np.stack(pdf.c.to_numpy()))
        return pd.DataFrame({"k": [int(pdf.k.min())], "members": [int(pdf.members.sum())], "px": [px.tolist()], "w": [foot.tolist()], "c": [c.tolist()]})

    return tagged.select("k", "members", "px", "w", "c", "component").groupBy("component").applyInPandas(run, "k long, members long, px array<long>, w array<double>, c array<double>")


def deconvolved_trace(y: np.ndarray) -> dict:
    noise = numerics.noise_level(y, how="logmexp")
    g = numerics.ar1_coefficient(y, noise)
    c, s, _ = numerics.constrained_ar1(y - min(y.min(), 0.0), g, noise)
    return {"g": g, "noise": noise, "c": c.tolist(), "s": s.tolist()}


def deconvolved(traces: DataFrame) -> DataFrame:
    """``k, g, noise, c, s`` of every trace, row by row and without a shuffle."""
    return numerics.map_traces(traces, deconvolved_trace, "g double, noise double, c array<double>, s array<double>")


def fit(pixels: DataFrame, rows: int, columns: int, options: FitOptions = FitOptions()) -> DataFrame:
    """The whole pipeline: ``k, members, px, w, g, noise, c, s``."""
    found = merged(fit_patches(pixels, rows, columns, options), options)
    return found.select("k", "members", "px", "w").join(deconvolved(found.select("k", "c")), "k")


def merged_to_fixpoint(components: DataFrame, options: FitOptions = FitOptions(), rounds: int = 50) -> DataFrame:
    """``merged`` again and again until no two components overlap and correlate."""
    now = cut(merged(components, options))
    n = now.count()
    for _ in range(rounds):
        now, before = cut(merged(now, options)), n
        n = now.count()
        if n == before:
            return now
    raise RuntimeError(f"components still merge after {rounds} rounds")


def footprints_of(components: DataFrame) -> DataFrame:
    """``k, px, w`` of packed components."""
    return components.select("k", F.explode(F.arrays_zip("px", "w")).alias("x")).select("k", F.col("x.px").alias("px"), F.col("x.w").alias("w"))


def refined(pixels: DataFrame, rows: int, columns: int, options: FitOptions = FitOptions()) -> DataFrame:
    """``k, px, w, g, noise, c, s``: patches merged to a fixpoint, then background, weights, and deconvolved traces once more over the whole field.

    Pixels are numbered along rows of ``columns``. Components that lose all pixels or their trace are dropped.
    """
    px = cut(images.shifted(pixels))
    found = merged_to_fixpoint(fit_patches(pixels, rows, columns, options), options)
    foot, traces = cut(footprints_of(found)), found.select("k", "c")
    b, f = rank_one_background(residual_movie(foot, traces, px))
    back = background_movie(b.select("px", F.array("b").alias("w")), f[None])
    noise = numerics.map_traces(px, lambda y: {"noise": numerics.noise_level(y)}, "noise double", "px", "trace")
    candidates = search_locations(foot, columns, rows, options.search)
    weights = cut(thresholded_footprints(update_spatial(px.join(noise, "px"), candidates, traces, background=back), columns))
    left = cut(px.join(back.select("px", F.col("trace").alias("back")), "px").select("px", F.zip_with("trace", "back", lambda x, y: x - y).alias("trace")))
    own = traces.join(weights.select("k").distinct(), "k", "left_semi")
    raw = temporal_hals(weights, left, own, 1, shape=lambda y: np.array(deconvolved_trace(y)["c"]))
    packed = weights.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("px", "w"))).alias("x")).select("k", F.col("x.px").alias("px"), F.col("x.w").alias("w"))
    return packed.join(deconvolved(raw), "k")


def register_sessions(sessions: list[DataFrame], share: float, exponent: float = 1.0, contained: float = 0.8, most: float = 0.5) -> DataFrame:
    """``u, session, k``: which component ``k`` of each session (a table ``k, px, w``) is union component ``u``.

    Sessions are matched one after the other with the union so far, in which a matched
    component takes the latest session's footprint and unmatched ones are added.
    """
    union = cut(sessions[0].select(F.col("k").alias("u"), "k", "px", "w"))
    out = [union.select("u", F.lit(0).alias("session"), "k").distinct()]
    for i, session in enumerate(sessions[1:], 1):
        session = cut(session)  # read four times
        masks = thresholded(session, share), thresholded(union.select(F.col("u").alias("k"), "px", "w"), share)
        pairs = cut(assignment(session_distances(*masks, exponent, contained, most)))
        last = union.agg(F.max("u")).first()[0]
        start = 0 if last is None else last + 1
        fresh = ranked_by(session.select("k").distinct().join(pairs.select(F.col("k1").alias("k")), "k", "left_anti"), "k").select("k", (F.col("rank") - 1 + start).cast("long").alias("u"))
        named = cut(pairs.select(F.col("k1").alias("k"), F.col("k2").alias("u")).unionByName(fresh))
        out.append(named.select("u", F.lit(i).alias("session"), "k"))
        union = cut(union.join(named.select("u"), "u", "left_anti").select("u", "k", "px", "w").union(session.join(named, "k").select("u", "k", "px", "w")))
    return functools.reduce(DataFrame.union, out)
