"""Queries of component masks, crops, activity and residuals, with their SQL twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from . import adapters as v
from .adapters import FOOT_SQL, MOVIE_SQL, TRACE_SQL
from .functions.stats import mean, r6
from .numeric_queries import _SPIKES, _spikes, _trace_query
from .operators import components, numerics
from .queries import _COV_SQL, _GRAM_SQL, query


@query("energy_mask", f"with {FOOT_SQL}, s as (select *, sum(w * w) over (partition by k order by w, px rows unbounded preceding) as below, sum(w * w) over (partition by k) as total from foot) select k, px, w from s where below > (1 - 0.9::double) * total")
def _(spark, sf):
    return components.energy_mask(v.footprints(spark, sf), 0.9)


@query("active_pixel_components", f"with {FOOT_SQL} select k, sum(case when px % 3 <> 0 then w * w else 0 end) >= 0.64 * sum(w * w) as keep from foot group by k")
def _(spark, sf):
    active = v.read(spark, sf, "part").select(F.col("p_partkey").alias("px")).where("px % 3 <> 0")
    return components.on_active_pixels(v.footprints(spark, sf), active, 0.8)


@query("order_components_events", f"""with {TRACE_SQL}, lv as (select k, avg(y) + 0.25 as level from trace group by k), a as (select k, t from trace join lv using (k) where y > level),
 i as (select k, t, t - row_number() over (partition by k order by t) as g from a), r as (select k, g, count(*) as n from i group by k, g having count(*) >= 2),
 e as (select lv.k, coalesce(sum(n), 0)::int as n from lv left join r using (k) group by lv.k) select k, n, row_number() over (order by n desc, k)::int as rank from e""")
def _(spark, sf):
    return components.ranked_by_events(components.event_frames(v.traces(spark, sf), mean(F.col("c")) + 0.25, 2))


@query("global_ar2", f"""with {_COV_SQL.replace("range(3)", "range(4)")}, w as (select k, max(v) filter (lag = 0) as v0, max(v) filter (lag = 1) as v1, max(v) filter (lag = 2) as v2, max(v) filter (lag = 3) as v3 from cov group by k),
 e as (select v0 - 0.001 as a, v1 as b, v1 as t from w union all select v1, v0 - 0.001, v2 from w union all select v2, v1, v3 from w),
 s as (select sum(a * a) as aa, sum(a * b) as ab, sum(b * b) as bb, sum(a * t) as ta, sum(b * t) as tb from e)
 select round((ta * bb - tb * ab) / (aa * bb - ab * ab), 6) + 0.0 as g1, round((tb * aa - ta * ab) / (aa * bb - ab * ab), 6) + 0.0 as g2 from s""")
def _(spark, sf):
    return components.stacked_ar2(v.traces(spark, sf), 3, 0.001).select(r6(F.col("g1")).alias("g1"), r6(F.col("g2")).alias("g2"))


@query("crop_footprints", f"with {FOOT_SQL}, m as (select k, round(sum(w * (px % 40)) / sum(w)) as r, round(sum(w * (px // 40)) / sum(w)) as c, sqrt(sum(w * w)) as norm from foot group by k), d as (select k, (px % 40 - r)::int as dr, (px // 40 - c)::int as dc, w / norm as w from foot join m using (k)) select k, dr, dc, round(w, 6) + 0.0 as w from d where abs(dr) <= 4 and abs(dc) <= 4")
def _(spark, sf):
    return components.crops(v.footprints(spark, sf), 40, 4).select("k", "dr", "dc", r6(F.col("w")).alias("w"))


@query("outline_json", f"with {FOOT_SQL}, b as (select k, count(*) as n, [min(px % 40), max(px % 40), min(px // 40), max(px // 40)] as bbox from foot group by k) select k, to_json({{'id': k, 'pixels': n, 'bbox': bbox}})::varchar as json from b")
def _(spark, sf):
    return components.outlines(v.footprints(spark, sf), 40)


@query("rolling_energy", f"with {MOVIE_SQL}, w as (select px, sum(y * y) over (partition by px order by t rows between 4 preceding and current row) / 5 as v from movie) select px, round(max(v), 6) + 0.0 as v from w group by px")
def _(spark, sf):
    return components.rolling_energy(v.pixels(spark, sf), 5).select("px", r6(F.col("v")).alias("v"))


@query("quick_merge_edges", f"""with {_GRAM_SQL}, {TRACE_SQL}, s as (select k1 as k, n as s from gram where k1 = k2), e as (select k1, k2 from gram join s a on a.k = k1 join s b on b.k = k2 where k1 < k2 and n / sqrt(a.s * b.s) > 0.2),
 d as (select k, t, y, y - lag(y) over (partition by k order by t) as rise from trace), sp as (select k, t, y, case when rise is null then null when rise >= 0.02 then rise else 0 end as s from d),
 c as (select k1, k2, corr(x.y, z.y) as rho, corr(x.s, z.s) as spike_rho from e join sp x on x.k = k1 join sp z on z.k = k2 and z.t = x.t group by k1, k2)
 select k1, k2, round(rho, 6) + 0.0 as rho, round(spike_rho, 6) + 0.0 as spike_rho from c where rho > 0.1 and spike_rho > 0""")
def _(spark, sf):
    tr = v.traces(spark, sf)
    d = components.triple_edges(v.footprints(spark, sf), tr, components.rises(tr, 0.02), 0.2, 0.1, 0.0)
    return d.select("k1", "k2", r6(F.col("rho")).alias("rho"), r6(F.col("spike_rho")).alias("spike_rho"))


@query("residual_movie", f"with {FOOT_SQL}, {MOVIE_SQL}, {TRACE_SQL}, m as (select px, trace.t, sum(w * y) as model from foot join trace using (k) where px in (select vec_id from embeddings) group by 1, 2) select px, t, round(y - coalesce(model, 0), 6) + 0.0 as y from movie left join m using (px, t)")
def _(spark, sf):
    d = components.residual_movie(v.footprints(spark, sf), v.traces(spark, sf), v.pixels(spark, sf))
    return v.unpack(d, "px").select("px", "t", r6(F.col("y")).alias("y"))


@query("tau_c2d", "select tau_d, tau_r, round(exp(-0.1 / tau_d), 6) + 0.0 as d, round(exp(-0.1 / tau_r), 6) + 0.0 as r from (select distinct p_size + 1.0::double as tau_d, (p_size + 1.0::double) / 4 as tau_r from part)")
def _(spark, sf):
    grid = v.read(spark, sf, "part").select((F.col("p_size") + F.lit(1.0)).alias("tau_d"), ((F.col("p_size") + F.lit(1.0)) / 4).alias("tau_r")).distinct()
    return components.poles_of_times(grid, 0.1).select("tau_d", "tau_r", r6(F.col("d")).alias("d"), r6(F.col("r")).alias("r"))


_RESPONSE = numerics.ar2_response(1.2, -0.4, 64)
_trace_query("oasis_ar2", _spikes(lambda y: numerics.convolution_nnls(y, _RESPONSE, 0.01)), _SPIKES)
_trace_query("thresholded_nnls", _spikes(lambda y: numerics.thresholded_spikes(y, _RESPONSE, 0.05)), _SPIKES)


def _detrended(y: np.ndarray) -> dict:
    return {"c": numerics.spline_detrended(y, 6).tolist()}


_trace_query("detrend_bspline", _detrended, "c array<double>")
