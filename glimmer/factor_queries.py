"""Queries of the factorisation's updates, neighbourhood filters and per-trace estimates, with SQL twins where SQL has them."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from . import adapters as v
from .adapters import FOOT_SQL, MOVIE_SQL, TRACE_SQL
from .functions.stats import r6
from .numeric_queries import _SPIKES, _field, _spread_traces, _trace_query
from .operators import factors, graphs, images, linalg, numerics, quality, spikes, traces, updates
from .plans import fit as plan
from .plans import preprocess
from .plans.lineage import cut, shared_folder
from .queries import _GRAM_SQL, query
from .sources import ingest

_AY_SQL = "ay as (select k, t, sum(w * y) as v from foot join movie using (px) group by k, t), ac as (select k1 as k, t, sum(v * y) as ac from gram join trace on k = k2 group by 1, 2)"


@query("temporal_step", f"with {_GRAM_SQL}, {MOVIE_SQL}, {TRACE_SQL}, {_AY_SQL} select k, t, round(greatest(0, y + (ay.v - ac) / g.v), 6) + 0.0 as y from trace join ay using (k, t) join ac using (k, t) join gram g on g.k1 = k and g.k2 = k")
def _(spark, sf):
    d = updates.least_squares_step(v.footprints(spark, sf), v.pixels(spark, sf), v.traces(spark, sf))
    return v.unpack(d, "k", values="c").select("k", "t", r6(F.greatest(F.lit(0.0), F.col("y"))).alias("y"))


def _peaks(spark, sf):
    """Footprints of their strongest pixels, which overlap as sparsely as cells in a field do."""
    foot = v.footprints(spark, sf)
    return foot.join(graphs.thresholded(foot, 0.8), ["k", "px"], "left_semi")


@query("temporal_hals")
def _(spark, sf):
    """One sweep over the components that the field holds, in the steps of the update order."""
    d = updates.temporal_hals(v.footprints(spark, sf), v.pixels(spark, sf), v.traces(spark, sf), sweeps=1)
    return d.select("k", F.transform("c", lambda x: F.round(x, 6)).alias("c"))


@query("update_order")
def _(spark, sf):
    foot = cut(_peaks(spark, sf))
    return updates.update_order(linalg.gram(foot).where("k1 <> k2"), foot.where("k is not null and px is not null"))


_DISK = ", ".join(f"({a}, {b})" for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4)


@query("search_locations_dilate", f"with {FOOT_SQL}, f as (select max(px) // 40 + 1 as cols from foot), n as (select k, px % 40 + a as r, px // 40 + b as c from foot, (values {_DISK}) o(a, b)) select distinct k, c * 40 + r as px from n, f where r >= 0 and r < 40 and c >= 0 and c < cols")
def _(spark, sf):
    foot = v.footprints(spark, sf)
    last = foot.agg(F.max("px")).first()[0] or 0
    return updates.search_locations(foot, 40, last // 40 + 1, 2)


@query("search_locations_ellipse", f"""with {FOOT_SQL}, f as (select max(px) // 40 + 1 as cols from foot), s as (select k, px % 40 as r, px // 40 as c, w / sum(w) over (partition by k) as p from foot),
 m as (select k, sum(p * r) as r, sum(p * c) as c, sum(p * r * r) - sum(p * r) ** 2 as vr, sum(p * c * c) - sum(p * c) ** 2 as vc, sum(p * r * c) - sum(p * r) * sum(p * c) as vx from s group by k),
 e as (select *, sqrt(((vr - vc) / 2) ** 2 + vx * vx) as h, atan2(2 * vx, vr - vc) / 2 as g from m),
 a as (select *, least(8, greatest(3, sqrt(greatest(0, (vr + vc) / 2 + h)))) as p, least(8, greatest(3, sqrt(greatest(0, (vr + vc) / 2 - h)))) as q from e),
 b as (select k, r, c, p, q, g, (round(r) + i)::bigint as y, (round(c) + j)::bigint as x from a, range(-24, 25) z(i), range(-24, 25) u(j))
 select k, x * 40 + y as px from b, f where y >= 0 and y < 40 and x >= 0 and x < cols and (((y - r) * cos(g) + (x - c) * sin(g)) / p) ** 2 + (((x - c) * cos(g) - (y - r) * sin(g)) / q) ** 2 <= 9""")
def _(spark, sf):
    foot = v.footprints(spark, sf)
    last = foot.agg(F.max("px")).first()[0] or 0
    return updates.ellipse_locations(foot, 40, last // 40 + 1)


_F0_SQL = f"{MOVIE_SQL}, f0 as (select t, greatest(0, avg(y)) as f from movie group by t), b as (select px, greatest(0, sum(y * f) / (select sum(f * f) from f0)) as b from movie join f0 using (t) group by px)"


def _background(spark, sf, rounds):
    return updates.rank_one_background(images.shifted(v.pixels(spark, sf)), rounds)


@query("background_image_step", f"with {_F0_SQL.replace('unnest(embedding)::double as y', 'unnest(embedding)::double - (select min(x) from (select unnest(embedding)::double as x from embeddings)) as y')} select px, round(b, 6) + 0.0 as b from b")
def _(spark, sf):
    return _background(spark, sf, 1)[0].select("px", r6(F.col("b")).alias("b"))


@query("background_frames_step", f"with {_F0_SQL.replace('unnest(embedding)::double as y', 'unnest(embedding)::double - (select min(x) from (select unnest(embedding)::double as x from embeddings)) as y')} select t, round(greatest(0, sum(b * y) / (select sum(b * b) from b)), 6) + 0.0 as f from movie join b using (px) group by t")
def _(spark, sf):
    f = _background(spark, sf, 1)[1]
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(f)], "t int, f double").select("t", r6(F.col("f")).alias("f"))


@query("background_rank_one")
def _(spark, sf):
    return _background(spark, sf, 50)[0].select("px", r6(F.col("b")).alias("b"))


@query("product_ab", f"with {FOOT_SQL}, {MOVIE_SQL}, b as (select px, avg(y) as b from movie group by px) select k, round(sum(w * b), 6) + 0.0 as v from foot join b using (px) group by k")
def _(spark, sf):
    b = v.pixels(spark, sf).select("px", (F.aggregate("trace", F.lit(0.0), lambda a, x: a + x) / F.size("trace")).alias("b"))
    return linalg.projected(v.footprints(spark, sf), b).select("k", r6(F.col("v")).alias("v"))


@query("product_yc", f"with {FOOT_SQL}, {MOVIE_SQL}, {TRACE_SQL} select k, px, round(sum(movie.y * trace.y), 6) + 0.0 as v from foot join trace using (k) join movie using (px, t) group by k, px")
def _(spark, sf):
    return linalg.pixel_products(v.pixels(spark, sf), v.traces(spark, sf), v.footprints(spark, sf)).select("k", "px", r6(F.col("v")).alias("v"))


@query("reconstruction_ac", f"with {FOOT_SQL}, {TRACE_SQL} select px, t, round(sum(w * y), 6) + 0.0 as y from foot join trace using (k) group by px, t")
def _(spark, sf):
    return v.unpack(linalg.reconstruction(v.footprints(spark, sf), v.traces(spark, sf)), "px").select("px", "t", r6(F.col("y")).alias("y"))


@query("singular_values")
def _(spark, sf):
    _, s, _ = linalg.leading_factors(v.pixels(spark, sf), 3)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(s)], "i int, s double").select("i", F.round("s", 3).alias("s"))


_KERNEL = np.array([[1.0, 2.0, 1.0], [0.0, 3.0, 0.0], [-1.0, -2.0, -1.0]])
_CELLS = ", ".join(f"({a - 1}, {b - 1}, {_KERNEL[a, b]}::double)" for a in range(3) for b in range(3) if _KERNEL[a, b])


@query("filter_replicate", f"with {MOVIE_SQL}, g as (select * from (values {_CELLS}) g(a, b, w)), n as (select max(r) as rows from movie) select p.px, p.t, round(sum(q.y * w), 6) + 0.0 as y from movie p, g, n, movie q where q.r = least(greatest(p.r + a, 0), rows) and q.c = least(greatest(p.c + b, 0), 24) and q.t = p.t group by 1, 2")
def _(spark, sf):
    d, rows, columns = _field(spark, sf)
    return v.unpack(images.filtered(d, _KERNEL, rows, columns), "px").select("px", "t", r6(F.col("y")).alias("y"))


@query("corr_image_3d", """with movie as (select vec_id as px, vec_id // 25 as r, vec_id % 5 as c, vec_id % 25 // 5 as z, unnest(range(64)) as t, unnest(embedding)::double as y from embeddings),
 s as (select px, avg(y) as m, stddev_pop(y) as sd from movie group by px), n as (select px, r, c, z, t, (y - m) / sd as v from movie join s using (px) where sd > 0),
 o as (select a, b, d from range(-1, 2) x(a), range(-1, 2) y(b), range(-1, 2) w(d) where a * a + b * b + d * d > 0 and a * a + b * b <= 1),
 rho as (select p.px, avg(p.v * q.v) as rho from n p, o, n q where q.r = p.r + a and q.c = p.c + b and q.z = p.z + d and q.t = p.t group by p.px, q.px)
 select px, round(avg(rho), 6) + 0.0 as rho from rho group by px""")
def _(spark, sf):
    d = v.pixels(spark, sf).withColumn("z", F.floor(F.col("c") / 5).cast("int")).withColumn("c", (F.col("c") % 5).cast("int"))
    return images.correlation_image(d, images.neighbourhood(1, 1)).select("px", r6(F.col("rho")).alias("rho"))


@query("peak_to_noise_image")
def _(spark, sf):
    d, rows, columns = _field(spark, sf)
    return images.peak_to_noise(d, images.centre_surround(7, 1.5), rows, columns).select("px", r6(F.col("pnr")).alias("pnr"))


@query("corr_image_endoscope")
def _(spark, sf):
    d, rows, columns = _field(spark, sf)
    d = images.peak_to_noise(d, images.centre_surround(7, 1.5), rows, columns, 1.0)
    return images.correlation_image(d, images.annulus(1, 2)).select("px", r6(F.col("rho")).alias("rho"))


@query("ring_background")
def _(spark, sf):
    d = v.pixels(spark, sf)
    noise = numerics.map_traces(d, lambda y: {"sn": numerics.noise_level(y)}, "sn double", "px", "trace")
    return images.ring_background(d, 3, noise).select("px", F.transform("trace", lambda x: F.round(x, 6)).alias("trace"))


@query("update_spatial")
def _(spark, sf):
    low = v.traces(spark, sf).agg(F.min(F.array_min("c"))).first()[0] or 0.0
    positive = v.traces(spark, sf).select("k", F.transform("c", lambda x: x - low).alias("c"))
    px = images.shifted(v.pixels(spark, sf))
    noise = numerics.map_traces(px, lambda y: {"noise": numerics.noise_level(y)}, "noise double", "px", "trace")
    d = updates.update_spatial(px.join(noise, "px"), v.footprints(spark, sf), positive)
    return d.select("k", "px", r6(F.col("w")).alias("w"))


@query("threshold_components")
def _(spark, sf):
    return updates.thresholded_footprints(v.footprints(spark, sf), 40, 0.9).select("k", "px", r6(F.col("w")).alias("w"))


@query("max_activity", f"with {TRACE_SQL}, w as (select k, t, sum(y) over (partition by k order by t rows between 4 preceding and current row) as s, count(*) over (partition by k order by t rows between 4 preceding and current row) as n from trace), b as (select k, t - 4 as start, s, row_number() over (partition by k order by round(s, 9) desc, t) as i from w where n = 5) select k, start::int as start, round(s / 5, 6) + 0.0 as mean from b where i = 1")
def _(spark, sf):
    d = numerics.map_traces(v.traces(spark, sf), lambda y: dict(zip(("start", "mean"), numerics.busiest(y, 5), strict=True)), "start int, mean double")
    return d.select("k", "start", r6(F.col("mean")).alias("mean"))


@query("resample_time", f"with {TRACE_SQL}, g as (select k, i, i / 2.0::double as x from (select distinct k from trace), range(127) z(i)) select g.k, i::int as t, round(a.y + (x - floor(x)) * (coalesce(b.y, a.y) - a.y), 6) + 0.0 as y from g join trace a on a.k = g.k and a.t = floor(x) left join trace b on b.k = g.k and b.t = floor(x) + 1")
def _(spark, sf):
    d = numerics.map_traces(v.traces(spark, sf), lambda y: {"c": np.interp(np.arange(2 * len(y) - 1) / 2, np.arange(len(y)), y).tolist()}, "c array<double>")
    return v.unpack(d, "k", values="c").select("k", "t", r6(F.col("y")).alias("y"))


_WELCH_SQL = "seg as (select px, s, i, y * (0.54 - 0.46 * cos(2 * pi() * i / 13)) as x from (select px, s, t - 7 * s as i, y from movie, range(8) z(s) where t >= 7 * s and t < 7 * s + 14)), dft as (select px, s, f, pow(sum(x * cos(2 * pi() * f * i / 256)), 2) + pow(sum(x * sin(2 * pi() * f * i / 256)), 2) as p from seg, range(64, 129) q(f) group by 1, 2, 3), u as (select sum(pow(0.54 - 0.46 * cos(2 * pi() * i / 13), 2)) as u from range(14) z(i)), psd as (select px, f, avg(p) / any_value(u) * case when f = 128 then 1 else 2 end as p from dft, u group by px, f)"


@query("noise_welch", f"with {MOVIE_SQL}, {_WELCH_SQL} select px, round(sqrt(exp(avg(ln(p / 2)))), 6) + 0.0 as sn from psd group by px")
def _(spark, sf):
    d = numerics.map_traces(v.pixels(spark, sf), lambda y: {"sn": numerics.welch_noise(y)}, "sn double", "px", "trace")
    return d.select("px", r6(F.col("sn")).alias("sn"))


@query("dff_auto")
def _(spark, sf):
    """dF/F over the movie's rank-one background, at the percentile that each trace's own density puts its mode at."""
    foot, px = v.footprints(spark, sf), images.shifted(v.pixels(spark, sf))
    b, f = updates.rank_one_background(px)
    back = factors.background_movie(linalg.projected(foot, b).select(F.col("k").alias("px"), F.array("v").alias("w")), f[None])
    norms = foot.groupBy("k").agg(F.sum(F.col("w") * F.col("w")).alias("norm2"))
    d = traces.dff_auto(v.traces(spark, sf), norms, back.select(F.col("px").alias("k"), F.col("trace").alias("b")))
    return d.select("k", r6(F.col("level")).alias("level"), F.transform("c", lambda x: F.round(x, 6)).alias("c"))


def _deconvolved(kind: str, method: str, **more):
    def one(y: np.ndarray) -> dict:
        d = numerics.deconvolve(y, kind, method, window=40, **more)
        return {"c": d["c"].tolist(), "s": d["s"].tolist()}

    return one


_trace_query("deconvolve_ar1", _deconvolved("ar1", "constrained", base=None), _SPIKES)
_trace_query("deconvolve_ar2", _deconvolved("ar2", "foopsi", lam=0.01, base=None), _SPIKES)
_trace_query("deconvolve_exp2", _deconvolved("exp2", "thresholded", smin=0.05, base=None), _SPIKES)
_trace_query("foopsi_baseline", lambda y: dict(zip(("c", "base"), ((r := numerics.foopsi_ar1(y, 0.8, 0.01))[0].tolist(), r[2]), strict=True)), "c array<double>, base double")


@query("active_pixels")
def _(spark, sf):
    """Two groups of pixels by the spectra of their traces; the group with less power in the high half is active."""
    return quality.active_pixels(v.pixels(spark, sf))


@query("legacy_quality_rule", f"with {FOOT_SQL}, {TRACE_SQL}, s as (select k, count(*) filter (w > 0.2 * top) as size from (select k, w, max(w) over (partition by k) as top from foot) group by k), z as (select k, max(y) as top, stddev_pop(y) as sd from trace group by k) select k, size >= 20 and size <= 400 and top > 2.2 * sd as keep from s join z using (k)")
def _(spark, sf):
    z = v.unpack(v.traces(spark, sf), "k", values="c").groupBy("k").agg(F.max("y").alias("top"), F.stddev_pop("y").alias("sd"))
    return quality.size_and_peak_rule(linalg.sizes(v.footprints(spark, sf), 0.2), z, 20, 400, 2.2)


@query("register_sessions")
def _(spark, sf):
    masks = [v.footprints(spark, sf, F.col("l_linenumber") % 3 == i) for i in range(3)]
    return plan.register_sessions(masks, share=0.15, most=0.92)


@query("merge_fixpoint")
def _(spark, sf):
    d = plan.merged_to_fixpoint(plan.fit_patches(*_field(spark, sf)))
    return d.select("k", "members", F.size("px").alias("n_pixels"), r6(F.array_max("c")).alias("top"))


@query("fit_refined")
def _(spark, sf):
    """The whole pipeline with background, one spatial and one temporal update after merging."""
    d = plan.refined(*_field(spark, sf))
    return d.select("k", F.size("px").alias("n_pixels"), r6(F.col("g")).alias("g"), r6(F.col("noise")).alias("noise"), F.size(F.filter("s", lambda x: x > 0)).alias("n_spikes"))


@query("order_sparse", f"with {FOOT_SQL}, {TRACE_SQL}, a as (select k, max(w) / sqrt(sum(w * w)) as top from foot group by k), s as (select k, max(y) * any_value(top) / sqrt(sum(y * y)) as score from trace join a using (k) group by k) select k, round(score, 6) + 0.0 as score, row_number() over (order by round(score, 9) desc, k)::int as rank from s")
def _(spark, sf):
    return linalg.sparse_order(v.footprints(spark, sf), v.traces(spark, sf)).select("k", r6(F.col("score")).alias("score"), "rank")


@query("contour_pixels", f"with {FOOT_SQL}, m as (select k, px, px % 40 as r, px // 40 as c from (select *, max(w) over (partition by k) as top from foot) where w > 0.2 * top) select k, px from m where (select count(*) from m n where n.k = m.k and abs(n.r - m.r) + abs(n.c - m.c) = 1) < 4")
def _(spark, sf):
    return updates.contour_pixels(v.footprints(spark, sf), 40, 0.2)


@query("trim_footprints")
def _(spark, sf):
    return updates.trimmed_footprints(v.footprints(spark, sf), 40, half=0, least=1).select("k", "px", r6(F.col("w")).alias("w"))


@query("regress_footprints")
def _(spark, sf):
    d = updates.regressed_footprints(v.pixels(spark, sf), v.footprints(spark, sf), v.traces(spark, sf))
    return d.select("k", "px", r6(F.col("w")).alias("w"))


_FIT = "mode double, noise double, fitness double"
_trace_query("fit_extreme", lambda y: numerics.exceedance(y, 8, "extreme", 1.0), _FIT)
_trace_query("fit_gaussian", lambda y: numerics.exceedance(y, 8), _FIT)


@query("start_seeded")
def _(spark, sf):
    d = plan.start_seeded(*_field(spark, sf), least_corr=0.1, least_pnr=2.0, level=1.0)
    return d.select("patch", "k", F.size("px").alias("n_pixels"), r6(F.array_max("c")).alias("top"))


_SHIFTED = "movie as (select vec_id as px, unnest(range(64)) as t, unnest(embedding)::double - (select min(x) from (select unnest(embedding)::double as x from embeddings)) as y from embeddings)"
_NMF_SQL = f"""{_SHIFTED}, h as (select t, max(y) filter (px = 0) as h0, max(y) filter (px = 1) as h1 from movie group by t),
 g as (select sum(h0 * h0) as a, sum(h0 * h1) as b, sum(h1 * h1) as d from h), yh as (select px, sum(y * h0) as p, sum(y * h1) as q from movie join h using (t) group by px),
 w as (select px, greatest(0, (d * p - b * q) / (a * d - b * b)) as w0, greatest(0, (a * q - b * p) / (a * d - b * b)) as w1 from yh, g)"""


def _two_traces(spark, sf):
    """The movie shifted to zero, and its first two pixels as temporal factors."""
    px = images.shifted(v.pixels(spark, sf))
    rows = px.where("px < 2").orderBy("px").select("trace").collect()
    return px, np.array([r["trace"] for r in rows])


@query("nmf_weights_step", f"with {_NMF_SQL} select px, round(w0, 6) + 0.0 as w0, round(w1, 6) + 0.0 as w1 from w")
def _(spark, sf):
    px, h = _two_traces(spark, sf)
    return factors.weight_rows(px, h, False).select("px", r6(F.col("w")[0]).alias("w0"), r6(F.col("w")[1]).alias("w1"))


@query("nmf_frames_step", f"""with {_NMF_SQL}, ww as (select sum(w0 * w0) as a, sum(w0 * w1) as b, sum(w1 * w1) as d from w), wy as (select t, sum(w0 * y) as p, sum(w1 * y) as q from movie join w using (px) group by t)
 select t::int as t, round(greatest(0, (d * p - b * q) / (a * d - b * b)), 6) + 0.0 as h0, round(greatest(0, (a * q - b * p) / (a * d - b * b)), 6) + 0.0 as h1 from wy, ww""")
def _(spark, sf):
    px, h = _two_traces(spark, sf)
    h = factors.nonnegative_factors(px, 2, 1, method="als", start=h)[1]
    return spark.createDataFrame([(t, float(a), float(b)) for t, (a, b) in enumerate(h.T)], "t int, h0 double, h1 double").select("t", r6(F.col("h0")).alias("h0"), r6(F.col("h1")).alias("h1"))


@query("nmf_rank_three", "select vec_id as px, true as optimal from embeddings")
def _(spark, sf):
    """Whether each pixel's weights satisfy the optimality conditions of the non-negative fit to the factors found."""
    px = images.shifted(v.pixels(spark, sf))
    w, h, _ = factors.nonnegative_factors(px, 3, 10)
    slope = factors.projections(px, h).withColumnRenamed("w", "b").join(w, "px")
    g = F.lit((h @ h.T).ravel().tolist())  # nine numbers
    left = [F.col("b")[i] - sum(F.col("w")[j] * g[3 * i + j] for j in range(3)) for i in range(3)]
    limit = 1e-6 * float(np.abs(h @ h.T).max())
    fits = [(F.col("w")[i] >= 0) & (left[i] <= limit) & ((F.col("w")[i] == 0) | (left[i] >= -limit)) for i in range(3)]
    return slope.select("px", (fits[0] & fits[1] & fits[2]).alias("optimal"))


@query("nmf_product", f"with {FOOT_SQL} select distinct px, true as nonnegative from foot join (select distinct vec_id as k from embeddings) using (k)")
def _(spark, sf):
    w, _ = factors.product_factors(v.footprints(spark, sf), v.traces(spark, sf), 3, 5)
    return w.select("px", F.forall("w", lambda x: x >= 0).alias("nonnegative"))


@query("background_svd", "select vec_id as px, true as orthogonal from embeddings")
def _(spark, sf):
    """Whether what two singular vectors leave of each pixel is orthogonal to them."""
    px = v.pixels(spark, sf)
    w, f = factors.background_model(px, "svd", 2)
    back = factors.background_movie(w, f).withColumnRenamed("trace", "back")
    rest = px.join(back, "px").select("px", F.zip_with("trace", "back", lambda x, y: x - y).alias("trace"))
    return factors.projections(rest, f).select("px", F.forall("w", lambda x: F.abs(x) < 1e-8).alias("orthogonal"))


@query("background_low_pass")
def _(spark, sf):
    w, _ = factors.background_model(v.pixels(spark, sf), "low_pass", 1, rate=0.2, size=6)
    return w.select("px", F.transform("w", lambda x: F.round(x, 6)).alias("w"))


@query("oasis_ar2_exact", "select vec_id as k, true as optimal from embeddings")
def _(spark, sf):
    """Whether the spikes found by pools satisfy the optimality conditions of the non-negative fit with penalty."""
    g1, g2, lam = 1.2, -0.35, 0.02

    def one(y: np.ndarray) -> dict:
        y = y - y.min()
        c, s = spikes.oasis_ar2(y, g1, g2, lam)
        pull = np.correlate(np.append(y - c, np.zeros(len(y) - 1)), numerics.ar2_response(g1, g2, len(y)), "valid") - lam
        return {"optimal": bool((s >= 0).all() and pull.max() < 1e-6 and np.abs(pull[s > 0]).max(initial=0.0) < 1e-6)}

    return numerics.map_traces(_spread_traces(spark, sf), one, "optimal boolean")


_trace_query("oasis_ar2_pools", lambda y: dict(zip(("c", "s"), (x.tolist() for x in spikes.oasis_ar2(y - y.min(), 1.2, -0.35, 0.0, 0.1)), strict=True)), _SPIKES)
_trace_query("decay_refined", lambda y: {k: x for k, x in spikes.refined_ar1(y, 0.8, 0.05, base=None).items() if k in ("g", "base")}, "g double, base double")
_trace_query("kernel_refined", lambda ys: spikes.refitted_kernels([y - y.min() for y in ys], 0.8, 0.3, 0.01, 40), "d double, r double", many=True)


_NOISE_SQL = "dft as (select px, f, pow(sum(y * cos(2 * pi() * f * t / 64)), 2) + pow(sum(y * sin(2 * pi() * f * t / 64)), 2) as p from movie, range(17, 33) z(f) group by px, f)"
_TOP_SQL = "top as (select 0.9 * (pow(2, ceil(log2(max(y)))) - 1) as most from movie)"


@query("preprocess", f"with {MOVIE_SQL}, {_NOISE_SQL}, {_TOP_SQL}, sn as (select px, sqrt(avg(p / 64 * case when f = 32 then 0.5 else 1 end)) as sn from dft group by px), sat as (select px, avg(case when y >= most then 1 else 0 end) as share from movie, top group by px) select px, round(sn, 6) + 0.0 as noise, share < 0.005 as unsaturated, 0 as n_missing from sn join sat using (px)")
def _(spark, sf):
    d, _ = preprocess.preprocessed(v.pixels(spark, sf))
    return d.select("px", r6(F.col("noise")).alias("noise"), "unsaturated", "n_missing")


@query("common_autoregression", """with movie as (select vec_id as px, unnest(range(64)) as t, unnest(embedding)::double as y from embeddings), m as (select px, avg(y) as m from movie group by px), x as (select px, t, y - m as x from movie join m using (px)),
 v as (select a.px, l, sum(a.x * b.x) / 64 - case when l = 0 then 0.0001 else 0 end as v from range(8) z(l), x a join x b on a.px = b.px and b.t = a.t + l group by 1, 2),
 e as (select p.px, p.v as t, a.v as a, b.v as b from v p join v a on a.px = p.px and a.l = p.l - 1 join v b on b.px = p.px and b.l = abs(p.l - 2) where p.l >= 1),
 s as (select sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * t) as ax, sum(b * t) as bx from e)
 select round((bb * ax - ab * bx) / (aa * bb - ab * ab), 6) + 0.0 as g1, round((aa * bx - ab * ax) / (aa * bb - ab * ab), 6) + 0.0 as g2 from s""")
def _(spark, sf):
    g = preprocess.common_autoregression(v.pixels(spark, sf).select("trace", F.lit(0.01).alias("noise")), 2, 5)
    return spark.createDataFrame([tuple(g)], "g1 double, g2 double").select(r6(F.col("g1")).alias("g1"), r6(F.col("g2")).alias("g2"))


@query("movie_binned", "with movie as (select vec_id as t, unnest(range(64)) as i, unnest(embedding)::double as y from embeddings), b as (select t // 4 as t, i // 8 - 1 as r, i % 8 - 2 as c, avg(y) as y, count(*) as n from movie where i // 8 between 1 and 6 and i % 8 between 2 and 6 group by 1, 2, 3) select t::int as t, (r * 5 + c)::int as i, round(y, 6) + 0.0 as y from b where n = 4")
def _(spark, sf):
    """Vectors as frames of 8 x 8 pixels, cropped and binned by four."""
    frames = v.read(spark, sf, "embeddings").select(F.lit("embeddings").alias("path"), F.col("vec_id").cast("int").alias("t"), F.lit(8).alias("rows"), F.lit(8).alias("columns"), v.doubles("embedding").alias("pixels"))
    d = ingest.converted(frames, 4, 1, 1, 2, 1)
    return d.select("t", F.posexplode_outer("pixels").alias("i", "y")).where("i is not null").select("t", "i", r6(F.col("y")).alias("y"))


@query("store_appended", "select vec_id::int as t, round(list_min(embedding)::double, 6) + 0.0 as least, (select round(min(list_min(embedding))::double, 6) + 0.0 from embeddings) as running from embeddings")
def _(spark, sf):
    """Frames appended to a store in two batches and read back, beside the least value that the store knows from its batches."""
    frames = v.read(spark, sf, "embeddings").select(F.lit("embeddings").alias("path"), F.col("vec_id").cast("int").alias("t"), F.lit(8).alias("rows"), F.lit(8).alias("columns"), v.doubles("embedding").alias("pixels"))
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    for batch in range(2):
        ingest.append_frames(frames.where(F.col("t") % 2 == batch), folder, batch)
    _, least = ingest.running_least(spark, folder)
    return ingest.stored_frames(spark, folder).select("t", r6(F.array_min("pixels")).alias("least"), r6(F.lit(least)).alias("running"))
