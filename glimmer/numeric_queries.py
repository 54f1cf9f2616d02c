"""Queries of per-trace numerics, quality and the pipeline."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from . import adapters as v
from .adapters import FOOT_SQL, MOVIE_SQL, TRACE_SQL
from .functions.stats import r6
from .operators import linalg, numerics, quality, spatial, traces
from .plans import fit as plan
from .queries import _GRAM_SQL, query

_DFT = "dft as (select px, f, pow(sum(y * cos(2 * pi() * f * t / 64)), 2) + pow(sum(y * sin(2 * pi() * f * t / 64)), 2) as p from movie, range(17, 33) z(f) group by px, f)"


@query("noise_psd", f"with {MOVIE_SQL}, {_DFT} select px, round(sqrt(avg(p / 64 * case when f = 32 then 0.5 else 1 end)), 6) + 0.0 as sn from dft group by px")
def _(spark, sf):
    d = numerics.map_traces(v.pixels(spark, sf), lambda y: {"sn": numerics.noise_level(y)}, "sn double", "px", "trace")
    return d.select("px", r6(F.col("sn")).alias("sn"))


_ACTIVE_SQL = f"{_GRAM_SQL}, {TRACE_SQL}, nrm as (select k1 as k, sqrt(v) as s from gram where k1 = k2), e as (select k1, k2 from gram join nrm a on a.k = k1 join nrm b on b.k = k2 where k1 <> k2 and v / (a.s * b.s) > 0.26), w as (select *, max(y) over f as top, min(y) over f as low from trace window f as (partition by k order by t rows between 5 preceding and 5 following)), pk as (select k, t from (select *, row_number() over (partition by k order by y desc, t) as n from w where y = top and top - low >= 0.25) where n <= 5), act as (select distinct k, unnest(range(greatest(t - 2, 0), least(t + 6, 63) + 1)) as t from pk), ex as (select k, t from act where not exists (select 1 from e join act o on o.k = e.k2 where e.k1 = act.k and o.t = act.t))"


def _exclusive(spark, sf):
    foot = v.footprints(spark, sf)
    active = quality.active_frames(traces.events(v.traces(spark, sf), 5, 0.25), 5, 2, 6, 64)
    return foot, quality.exclusive_frames(active, linalg.cosine_edges(foot, 0.26))


@query("frame_exclusion", f"with {_ACTIVE_SQL} select k, t from ex")
def _(spark, sf):
    return _exclusive(spark, sf)[1]


@query("frame_exclusion_corr", f"with {_ACTIVE_SQL}, {MOVIE_SQL}, im as (select ex.k, foot.px, avg(y) as m, any_value(w) as w from ex join foot on foot.k = ex.k join movie on movie.px = foot.px and movie.t = ex.t group by 1, 2) select k, count(*) as n, case when stddev_pop(m) * stddev_pop(w) > 0 then round(covar_pop(m, w) / (stddev_pop(m) * stddev_pop(w)), 6) + 0.0 end as rho from im group by k")
def _(spark, sf):
    foot, frames = _exclusive(spark, sf)
    return quality.spatial_match(frames, foot, v.pixels(spark, sf)).select("k", "n", r6(F.col("rho")).alias("rho"))


@query("quality_keep_rule", f"with {FOOT_SQL}, {TRACE_SQL}, s as (select k, count(*) filter (w > 0.2 * top) as size from (select k, w, max(w) over (partition by k) as top from foot) group by k), z as (select k, max(y) / stddev_pop(y) as z, avg(y) as m from trace group by k) select k, coalesce((size >= 500 or m > 0) and z > 2.2, false) as keep from s left join z using (k)")
def _(spark, sf):
    size = linalg.sizes(v.footprints(spark, sf), 0.2)
    z = v.unpack(v.traces(spark, sf), "k", values="c").groupBy("k").agg((F.max("y") / F.stddev_pop("y")).alias("z"), F.avg("y").alias("m"))
    return size.join(z, "k", "left").select("k", quality.keep_rule(F.col("size") >= 500, F.col("m") > 0, F.col("z") > 2.2).alias("keep"))


def _spread_traces(spark, sf):
    """Traces for some hundred operations a sample: tasks for all cores are worth the shuffle, also where the table is one file of one part."""
    return v.traces(spark, sf).repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "k")


def _trace_query(name: str, f, schema: str, many: bool = False):
    rounded = [x.split() for x in schema.split(", ")]

    @query(name)
    def _(spark, sf):
        d = numerics.map_traces(_spread_traces(spark, sf), f, schema, many=many)
        return d.select("k", *(r6(F.col(c)).alias(c) if t == "double" else F.transform(c, lambda x: F.round(x, 6)).alias(c) if t == "array<double>" else F.col(c) for c, t in rounded))


_SPIKES = "c array<double>, s array<double>"


def _spikes(f):
    def one(y: np.ndarray) -> dict:
        c, s = f(y - y.min())[:2]
        return {"c": c.tolist(), "s": s.tolist()}

    return one


_trace_query("oasis_ar1", _spikes(lambda y: numerics.oasis_ar1(y, 0.8, 0.05)), _SPIKES)
_trace_query("oasis_constrained", _spikes(lambda y: numerics.constrained_ar1(y, 0.8, numerics.noise_level(y))), _SPIKES)
_trace_query("oasis_thresholded", _spikes(lambda y: numerics.thresholded_ar1(y, 0.8, numerics.noise_level(y))), _SPIKES)
_KERNEL = np.array([math.exp(-t / 5) - math.exp(-t / 1) if t else 0.0 for t in range(1, 33)])
_trace_query("onnls", _spikes(lambda y: numerics.convolution_nnls(y, _KERNEL, 0.01)), _SPIKES)
_trace_query("event_exceptionality", numerics.event_fitness, "fitness double, mode double, sd double")
_trace_query("kde_mode", numerics.kde_mode, "mode double, level double")


def _spatial(spark, sf, solve):
    """``px, k (array), w (array)``: each pixel on the traces of the components whose footprints hold it, gathered by a join."""
    c = v.traces(spark, sf)
    low = c.agg(F.min(F.array_min("c"))).first()[0]
    px = v.pixels(spark, sf)
    d = spatial.pixel_weights(px, v.footprints(spark, sf), c, lambda y, c, _: solve(c - low, y))
    d = px.select("px").join(d, "px", "left").select("px", *(F.coalesce(x, F.array().cast(f"array<{t}>")).alias(x) for x, t in (("k", "long"), ("w", "double"))))
    return d.select("px", "k", F.transform("w", lambda x: F.round(x, 6)).alias("w"))


@query("nnls_spatial")
def _(spark, sf):
    return _spatial(spark, sf, lambda c, y: numerics.nnls(c.T, y - y.min()))


@query("lasso_spatial")
def _(spark, sf):
    z = numerics.NORMAL.inv_cdf(0.75)

    def one(c: np.ndarray, y: np.ndarray) -> np.ndarray:
        return numerics.soft_hals(c @ (y - y.min()), c @ c.T, z * numerics.noise_level(y) * np.sqrt((c * c).sum(axis=1)), np.ones(len(c), bool))

    return _spatial(spark, sf, one)


def _field(spark, sf):
    """Pixels, and the rows and columns of the grid that holds all of them."""
    d = v.pixels(spark, sf)
    last = d.agg(F.max("r")).first()[0]
    return d, 0 if last is None else last + 1, v.GRID_COLUMNS


@query("greedy_init_patch")
def _(spark, sf):
    d = plan.fit_patches(*_field(spark, sf), plan.FitOptions(sweeps=0))
    return d.select("patch", "k", F.size("px").alias("n_pixels"), r6(F.array_max("c")).alias("top"))


@query("fit_patches")
def _(spark, sf):
    d = plan.fit_patches(*_field(spark, sf))
    return d.select("patch", "k", F.size("px").alias("n_pixels"), r6(F.array_max("c")).alias("top"))


@query("merge_rank1")
def _(spark, sf):
    d = plan.merged(plan.fit_patches(*_field(spark, sf)))
    return d.select("k", "members", F.size("px").alias("n_pixels"), r6(F.array_max("c")).alias("top"))


@query("fit_pipeline")
def _(spark, sf):
    d = plan.fit(*_field(spark, sf))
    return d.select("k", "members", F.size("px").alias("n_pixels"), r6(F.col("g")).alias("g"), r6(F.col("noise")).alias("noise"), F.size(F.filter("s", lambda x: x > 0)).alias("n_spikes"))




@query("spatial_at_noise", f"with {FOOT_SQL} select px, count(*)::int as n, true as at_noise from foot join (select vec_id as px from embeddings) using (px) join (select vec_id as k from embeddings) using (k) group by px")
def _(spark, sf):
    """The weights of least sum within each pixel's noise; ``at_noise``: the residual is that of the noise, or all it can be."""
    c = v.traces(spark, sf)
    low = c.agg(F.min(F.array_min("c"))).first()[0] or 0.0
    c = c.select("k", F.transform("c", lambda x: x - low).alias("c"))
    px = v.pixels(spark, sf)
    px = px.join(numerics.map_traces(px, lambda y: {"noise": numerics.noise_level(y)}, "noise double", "px", "trace"), "px")
    d = spatial.weights_at_noise(px, v.footprints(spark, sf), c)
    left = px.join(d, "px").join(linalg.reconstruction(spatial.positive(d), c).withColumnRenamed("trace", "fit"), "px", "left")
    rest = F.when(F.col("fit").isNull(), F.col("trace")).otherwise(F.zip_with("trace", "fit", lambda x, y: x - y))
    left = left.select("px", F.size("k").alias("n"), "reached", "w", rest.alias("rest"), (F.col("noise") ** 2 * F.size("trace")).alias("most"))
    size = F.aggregate("rest", F.lit(0.0), lambda a, x: a + x * x)
    none = ~F.exists("w", lambda x: x > 0)
    return left.select("px", "n", F.when(F.col("reached"), F.abs(size - F.col("most")) < 1e-6 * size).otherwise(size > F.col("most")).alias("near"), none.alias("none"), (size <= F.col("most")).alias("less")).select("px", "n", (F.col("near") | F.col("none") & F.col("less")).alias("at_noise"))
