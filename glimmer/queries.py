"""Queries over the driver tables and their SQL twins; see ``adapters`` for the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import adapters as v
from .adapters import FOOT_SQL, MOVIE_SQL, TRACE_SQL
from .functions.stats import hazen_sql, r6
from .operators import graphs, images, linalg, patches, traces
from .plans.lineage import cut

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _corr_sql(offsets, ctes: str = MOVIE_SQL, block: str = "0") -> str:
    near = ", ".join(f"({a}, {b})" for a, b in offsets)
    return f"""with {ctes}, s as (select px, {block} as b, avg(y) as m, stddev_pop(y) as sd from movie group by 1, 2),
 z as (select px, r, c, t, {block} as b, (y - m) / sd as z from movie join s using (px) where s.b = {block} and sd > 0),
 rho as (select p.px, p.b, p.r + dr as nr, p.c + dc as nc, avg(p.z * q.z) as rho from z p, (values {near}) o(dr, dc), z q
   where q.r = p.r + dr and q.c = p.c + dc and q.t = p.t and q.b = p.b group by all),
 img as (select px, b, avg(rho) as rho from rho group by all)
select px, round(max(rho), 6) + 0.0 as rho from img group by px"""


for _name, _offsets in (("4", images.FOUR), ("8", images.EIGHT), ("annulus", images.annulus(1.5, 3))):
    query(f"corr_image_{_name}", _corr_sql(_offsets))(lambda spark, sf, o=_offsets: images.correlation_image(v.pixels(spark, sf), o).select("px", r6(F.col("rho")).alias("rho")))


@query("corr_image_max", _corr_sql(images.FOUR, block="t // 32"))
def _(spark, sf):
    return images.correlation_image(v.pixels(spark, sf), images.FOUR, 32, 8).select("px", r6(F.col("rho")).alias("rho"))


@query("mean_image", f"with {MOVIE_SQL} select px, round(avg(y), 6) + 0.0 as mean, round(median(y), 6) + 0.0 as median from movie group by px")
def _(spark, sf):
    return v.movie(spark, sf).groupBy("px").agg(r6(F.avg("y")).alias("mean"), r6(F.median("y")).alias("median"))


@query("std_image", f"with {MOVIE_SQL} select px, round(stddev_pop(y), 6) + 0.0 as sd, round(stddev_samp(y), 6) + 0.0 as sd_sample from movie group by px")
def _(spark, sf):
    return v.movie(spark, sf).groupBy("px").agg(r6(F.stddev_pop("y")).alias("sd"), r6(F.stddev_samp("y")).alias("sd_sample"))


@query("minshift_movie", f"with {MOVIE_SQL} select px, t, round(y - (select min(y) from movie), 6) + 0.0 as y from movie")
def _(spark, sf):
    return v.unpack(images.shifted(v.pixels(spark, sf)), "px").select("px", "t", r6(F.col("y")).alias("y"))


@query("unsaturated_pixels", f"with {MOVIE_SQL}, s as (select px, (y - (select min(y) from movie)) * 1000 as y from movie), lim as (select 0.6 * (pow(2, ceil(log2(max(y)))) - 1) as l from s) select px, round(avg((y >= l)::int), 6) + 0.0 as saturated from s, lim group by px having avg((y >= l)::int) < 0.2")
def _(spark, sf):
    d = images.shifted(v.pixels(spark, sf)).withColumn("trace", F.transform("trace", lambda x: x * 1000))
    return images.unsaturated(d, 0.6, 0.2).select("px", r6(F.col("saturated")).alias("saturated"))


for _name, _power, _agg in (("mean", 1, "avg(y)"), ("max", None, "max(y)"), ("pow", 3, "pow(avg(pow(y, 3)), 1 / 3.0)")):
    query(f"downsample_time_{_name}", f"with {MOVIE_SQL}, s as (select px, t, y - (select min(y) from movie) as y from movie) select px, t // 4 as t, round({_agg}, 6) + 0.0 as y from s group by px, t // 4")(
        lambda spark, sf, p=_power: v.unpack(images.downsample_time(images.shifted(v.pixels(spark, sf)), 4, p), "px").select("px", "t", r6(F.col("y")).alias("y"))
    )


@query("downsample_space_box", f"with {MOVIE_SQL} select r // 5 as r, c // 5 as c, t, round(avg(y), 6) + 0.0 as y from movie group by 1, 2, 3")
def _(spark, sf):
    return images.downsample_space(v.movie(spark, sf), 5).select("r", "c", "t", r6(F.col("y")).alias("y"))


_GAPS = "(px * 31 + t * 7) % 11 = 0 or (px % 5 = 0 and (t < 2 or t > 60))"


@query("interp_missing", f"""with {MOVIE_SQL}, g as (select px, t, case when {_GAPS} then null else y end as y from movie),
 k as (select px, list(t order by t) filter (y is not null) as ts, list(y order by t) filter (y is not null) as ys from g group by px),
 i as (select g.px, g.t, g.y, ts, ys, greatest(1, least(len(ts) - 1, len(list_filter(ts, lambda x: x < g.t)))) as j from g join k using (px))
 select px, t, round(coalesce(y, ys[j] + (ys[j + 1] - ys[j]) * (t - ts[j]) / (ts[j + 1] - ts[j])), 6) + 0.0 as y from i""")
def _(spark, sf):
    d = v.movie(spark, sf).withColumn("y", F.when(~F.expr(_GAPS), F.col("y")))
    return images.interpolated(d).select("px", "t", r6(F.col("y")).alias("y"))


_TAPS = ", ".join(f"({i - 2}, {x!r}::double)" for i, x in enumerate(images.gaussian_taps(1.2, 2)))


@query("gaussian_blur", f"with {MOVIE_SQL}, g as (select * from (values {_TAPS}) g(d, w)) select p.px, p.t, round(sum(q.y * a.w * b.w), 6) + 0.0 as y from movie p, g a, g b, movie q where q.r = p.r + a.d and q.c = p.c + b.d and q.t = p.t group by 1, 2")
def _(spark, sf):
    return v.unpack(images.blurred(v.pixels(spark, sf), 1.2, 2), "px").select("px", "t", r6(F.col("y")).alias("y"))


_PATCH_SQL = f"""ax as (select 0 as ax, coalesce(max(vec_id) // {v.GRID_COLUMNS} + 1, 0) as n from embeddings union all select 1, {v.GRID_COLUMNS}),
 st as (select ax, n, unnest(range(0, greatest(1, n - 2), 6)) as a from ax where n > 0),
 sp as (select ax, n, a, least(a + 8, n) - 1 as b, lead(a) over (partition by ax order by a) as nxt, lead(least(a + 8, n) - a) over (partition by ax order by a) as nl from st),
 axis as (select ax, a, case when nxt is not null and nl < 3 and nxt = max(a) over (partition by ax) then n - 1 else b end as b from sp where not (b - a + 1 < 3 and a = (select max(a) from st s where s.ax = sp.ax))),
 grid as (select row_number() over (order by y.a, x.a)::int - 1 as patch, x.a as r0, x.b as r1, y.a as c0, y.b as c1 from axis x, axis y where x.ax = 0 and y.ax = 1)"""


def _grid(spark, sf):
    """Patches over all rows that the table's vectors fill."""
    last = v.pixels(spark, sf).agg(F.max("r")).first()[0]
    return patches.patch_grid(spark, 0 if last is None else last + 1, v.GRID_COLUMNS, 8, 2, 3)


@query("patch_grid", f"with {_PATCH_SQL} select patch, r0::int as r0, r1::int as r1, c0::int as c0, c1::int as c1 from grid")
def _(spark, sf):
    return _grid(spark, sf)


@query("patch_pixels", f"with {_PATCH_SQL}, {MOVIE_SQL} select patch, px from grid join (select distinct px, r, c from movie) m on r between r0 and r1 and c between c0 and c1")
def _(spark, sf):
    return v.pixels(spark, sf).join(patches.patch_pixels(_grid(spark, sf)), ["r", "c"]).select("patch", "px")


@query("patch_coverage_mean", f"with {_PATCH_SQL}, {MOVIE_SQL}, m as (select r, c, avg(y) as y from movie group by r, c) select r, c, count(*) as n, round(avg(y * (patch + 1)), 6) + 0.0 as value from grid join m on r between r0 and r1 and c between c0 and c1 group by r, c")
def _(spark, sf):
    d = v.pixels(spark, sf).select("r", "c", (F.aggregate("trace", F.lit(0.0), lambda a, x: a + x) / F.size("trace")).alias("y"))
    d = d.join(patches.patch_pixels(_grid(spark, sf)), ["r", "c"]).withColumn("value", F.col("y") * (F.col("patch") + 1))
    return patches.coverage_mean(d).select("r", "c", "n", r6(F.col("value")).alias("value"))


@query("com_2d", f"with {FOOT_SQL} select k, round(sum(w * (px % 40)) / sum(w), 6) + 0.0 as r, round(sum(w * (px // 40)) / sum(w), 6) + 0.0 as c from foot group by k")
def _(spark, sf):
    return linalg.centers(v.footprints(spark, sf), 40).select("k", r6(F.col("r")).alias("r"), r6(F.col("c")).alias("c"))


@query("component_size", f"with {FOOT_SQL} select k, count(*) filter (w > 0.2 * top) as size from (select k, w, max(w) over (partition by k) as top from foot) group by k")
def _(spark, sf):
    return linalg.sizes(v.footprints(spark, sf), 0.2)


@query("l2_normalise", f"with {FOOT_SQL}, n as (select k, sqrt(sum(w * w)) as norm from foot group by k) select k, px, round(w / norm, 6) + 0.0 as w, round(norm, 6) + 0.0 as norm from foot join n using (k)")
def _(spark, sf):
    return linalg.normalised(v.footprints(spark, sf)).select("k", "px", r6(F.col("w")).alias("w"), r6(F.col("norm")).alias("norm"))


@query("order_components_norm", f"with {FOOT_SQL}, {TRACE_SQL}, n as (select k, sqrt(sum(w ** 2)) as n2, pow(sum(w ** 4), 0.25) as n4 from foot group by k), m as (select k, max(y) as top from trace group by k), s as (select k, top * n2 * (n4 / n2) as score from n join m using (k)) select k, round(score, 6) + 0.0 as score, row_number() over (order by score desc, k)::int as rank from s")
def _(spark, sf):
    return linalg.ranked(v.footprints(spark, sf), v.traces(spark, sf)).select("k", r6(F.col("score")).alias("score"), "rank")


_GRAM_SQL = f"{FOOT_SQL}, gram as (select x.k as k1, y.k as k2, sum(x.w * y.w) as v, count(*) as n from foot x join foot y using (px) group by 1, 2)"


@query("gram_aa", f"with {_GRAM_SQL} select k1, k2, round(v, 6) + 0.0 as v, n from gram")
def _(spark, sf):
    return linalg.gram(v.footprints(spark, sf)).select("k1", "k2", r6(F.col("v")).alias("v"), "n")


@query("product_ay", f"with {FOOT_SQL}, {MOVIE_SQL} select k, t, round(sum(w * y), 6) + 0.0 as v from foot join movie using (px) group by k, t")
def _(spark, sf):
    d = linalg.product_ay(v.footprints(spark, sf), v.pixels(spark, sf))
    return v.unpack(d, "k", values="ay").select("k", "t", r6(F.col("y")).alias("v"))


@query("residual_traces", f"with {_GRAM_SQL}, {MOVIE_SQL}, {TRACE_SQL}, ay as (select k, t, sum(w * y) as v from foot join movie using (px) group by k, t), ac as (select k1 as k, t, sum(v * y) as ac from gram join trace on k = k2 group by 1, 2), nn as (select k1 as k, v as norm from gram where k1 = k2) select k, t, round((v - coalesce(ac, 0)) / norm, 6) + 0.0 as v from ay left join ac using (k, t) join nn using (k)")
def _(spark, sf):
    d = linalg.residual_traces(v.footprints(spark, sf), v.pixels(spark, sf), v.traces(spark, sf))
    return v.unpack(d, "k", values="c").select("k", "t", r6(F.col("y")).alias("v"))


@query("cosine_overlap_edges", f"with {_GRAM_SQL}, s as (select k1 as k, sqrt(v) as s from gram where k1 = k2) select k1, k2, round(v / (a.s * b.s), 6) + 0.0 as cosine from gram join s a on a.k = k1 join s b on b.k = k2 where k1 < k2 and v / (a.s * b.s) > 0.2")
def _(spark, sf):
    return linalg.cosine_edges(v.footprints(spark, sf), 0.2).select("k1", "k2", r6(F.col("cosine")).alias("cosine"))


@query("binary_overlap_edges", f"with {_GRAM_SQL}, s as (select k1 as k, n as s from gram where k1 = k2) select k1, k2, round(n / sqrt(a.s * b.s), 6) + 0.0 as overlap from gram join s a on a.k = k1 join s b on b.k = k2 where k1 < k2 and n / sqrt(a.s * b.s) > 0.25")
def _(spark, sf):
    return linalg.binary_edges(v.footprints(spark, sf), 0.25).select("k1", "k2", r6(F.col("overlap")).alias("overlap"))


_SESSION_SQL = "m1 as (select k, px from (select *, max(w) over (partition by k) as top from (select l_suppkey as k, l_partkey as px, sum(l_quantity) as w from lineitem where l_linenumber % 2 = 0 group by 1, 2)) where w >= 0.15 * top), m2 as (select k, px from (select *, max(w) over (partition by k) as top from (select l_suppkey as k, l_partkey as px, sum(l_quantity) as w from lineitem where l_linenumber % 2 = 1 group by 1, 2)) where w >= 0.15 * top)"
_DIST_SQL = f"{_SESSION_SQL}, n1 as (select k, count(*) as n from m1 group by k), n2 as (select k, count(*) as n from m2 group by k), i as (select m1.k as k1, m2.k as k2, count(*) as n from m1 join m2 using (px) group by 1, 2), dist as (select k1, k2, case when i.n >= 0.8 * least(n1.n, n2.n) then 0.0 else 1 - i.n / (n1.n + n2.n - i.n)::double end as d from i join n1 on n1.k = k1 join n2 on n2.k = k2)"


def _masks(spark, sf, odd: int):
    return graphs.thresholded(v.footprints(spark, sf, F.col("l_linenumber") % 2 == odd), 0.15)


def _distances(spark, sf, most: float):
    return graphs.session_distances(_masks(spark, sf, 0), _masks(spark, sf, 1), 1.0, 0.8, most)


@query("iou_distance", f"with {_DIST_SQL} select k1, k2, round(d, 6) + 0.0 as d from dist")
def _(spark, sf):
    return _distances(spark, sf, 1.0).select("k1", "k2", r6(F.col("d")).alias("d"))


@query("session_match_candidates", f"with {_DIST_SQL} select k1, k2, round(d, 6) + 0.0 as d from dist where d <= 0.92")
def _(spark, sf):
    return _distances(spark, sf, 0.92).select("k1", "k2", r6(F.col("d")).alias("d"))


for _side, _odd in (("left", 0), ("right", 1)):
    query(f"nonmatched_{_side}", f"with {_DIST_SQL} select distinct k from m{_odd + 1} where k not in (select k{_odd + 1} from dist where d <= 0.9)")(lambda spark, sf, o=_odd: graphs.nonmatched(_masks(spark, sf, o), _distances(spark, sf, 0.9), f"k{o + 1}"))


@query("assignment_optimal")
def _(spark, sf):
    return graphs.assignment(_distances(spark, sf, 0.92)).select("k1", "k2", r6(F.col("d")).alias("d"))


_EDGE_SQL = f"{_GRAM_SQL}, {TRACE_SQL}, s as (select k1 as k, sqrt(v) as s from gram where k1 = k2), e as (select k1, k2 from gram join s a on a.k = k1 join s b on b.k = k2 where k1 < k2 and v / (a.s * b.s) > 0.15), edge as (select k1, k2, corr(x.y, z.y) as rho from e join trace x on x.k = k1 join trace z on z.k = k2 and z.t = x.t group by k1, k2 having corr(x.y, z.y) >= 0.35)"
_CC_SQL = f"{_EDGE_SQL}, bi as (select k1 as a, k2 as b from edge union all select k2, k1 from edge), reach as (select a as k, b as r from bi union select reach.k, bi.b from reach join bi on bi.a = reach.r), comp as (select k, least(k, min(r)) as component from reach group by k)"


def _edges(spark, sf):
    return graphs.correlated_edges(v.footprints(spark, sf), v.traces(spark, sf), 0.15, 0.35)


@query("trace_corr_edges", f"with {_EDGE_SQL} select k1, k2, round(rho, 6) + 0.0 as rho from edge")
def _(spark, sf):
    return _edges(spark, sf).select("k1", "k2", r6(F.col("rho")).alias("rho"))


@query("merge_components_cc", f"with recursive {_CC_SQL} select k, component from comp")
def _(spark, sf):
    return graphs.merge_groups(_edges(spark, sf))


@query("merge_rank_score", f"with recursive {_CC_SQL}, sc as (select component, round(sum(rho), 9) as score from edge join comp on comp.k = k1 group by component), sz as (select component, count(*) as size from comp group by component), rk as (select component, score, size, row_number() over (order by score desc, component)::int as rank from sc join sz using (component)) select component, round(score, 6) + 0.0 as score, size, rank from rk where rank <= 50")
def _(spark, sf):
    e = cut(_edges(spark, sf))  # read twice, formed once
    return graphs.merge_scores(e, graphs.merge_groups(e), 50).select("component", r6(F.col("score")).alias("score"), "size", "rank")


_LIST_SQL = "tr as (select vec_id as k, list_transform(embedding, lambda x: x::double) as c from embeddings)"


def _traces_of(d, *columns):
    return v.unpack(d, *columns, values="c").select(*columns, "t", r6(F.col("y")).alias("y"))


@query("dff_global", f"""with {FOOT_SQL}, {_LIST_SQL}, n as (select k, sum(w * w) / 1000 as norm2 from foot group by k),
 f as (select k, list_transform(c, lambda x: x * norm2) as f, list_transform(c, lambda x: x * 0.5 + 3) as b from tr join n using (k)),
 q as (select k, f, {hazen_sql("f", 0.2)} as fd, {hazen_sql("b", 0.2)} + {hazen_sql("f", 0.2)} as f0 from f)
 select k, unnest(range(64)) as t, round((unnest(f) - fd) / f0, 6) + 0.0 as y from q where f0 <> 0""")
def _(spark, sf):
    tr = v.traces(spark, sf)
    norms = v.footprints(spark, sf).groupBy("k").agg((F.sum(F.col("w") * F.col("w")) / 1000).alias("norm2"))
    return _traces_of(traces.dff_global(tr, norms, tr.select("k", F.transform("c", lambda x: x * 0.5 + 3).alias("b")), 0.2), "k")


def _filter_sql(p: float, window: int, shift: int) -> str:
    h = window // 2
    return f"""pad as (select k, c, list_concat(list_transform(range({h}), lambda x: c[1]), c, list_transform(range({window}), lambda x: c[64])) as p from tr),
 blk as (select k, i, p[i * {shift} + 1 : i * {shift} + {window}] as w from pad, range({-(-64 // shift)}) z(i)), bq as (select k, i, {hazen_sql("w", p)} as q from blk),
 base as (select a.k, t.t, a.q + (t.t / {shift}.0 - t.t // {shift}) * (coalesce(b.q, a.q) - a.q) as base from range(64) t(t) join bq a on a.i = t.t // {shift} left join bq b on b.k = a.k and b.i = a.i + 1)"""


@query("percentile_filter", f"with {_LIST_SQL}, {_filter_sql(0.2, 16, 6)} select k, t, round(base, 6) + 0.0 as y from base")
def _(spark, sf):
    return _traces_of(traces.percentile_filter(v.traces(spark, sf), 0.2, 16, 6).select("k", F.col("base").alias("c")), "k")


@query("running_percentile", f"with {_LIST_SQL}, pad as (select k, list_concat(list_reverse(c[1:5]), c, list_reverse(c[60:64])) as p from tr), w as (select k, t, p[t + 1 : t + 11] as w from pad, range(64) z(t)) select k, t, round({hazen_sql('w', 0.3)}, 6) + 0.0 as y from w")
def _(spark, sf):
    return _traces_of(traces.running_percentile(v.traces(spark, sf), 0.3, 11).select("k", F.col("base").alias("c")), "k")


def _norms(spark, sf):
    return v.footprints(spark, sf).groupBy("k").agg((F.sum(F.col("w") * F.col("w")) / 1000).alias("norm2"))


def _background(spark, sf):
    """A stand-in for A'b f: the component's trace halved and raised."""
    return v.traces(spark, sf).select("k", F.transform("c", lambda x: x * 0.5 + 3).alias("b"))


_NORM_SQL = f"{FOOT_SQL}, n as (select k, sum(w * w) / 1000 as norm2 from foot group by k)"
_F_FILTER_SQL = _filter_sql(0.2, 16, 6).replace("from tr)", "from fl)").replace("select k, c, list_concat", "select k, c, list_concat")
_B_FILTER_SQL = _F_FILTER_SQL.replace("pad as", "padb as").replace("blk as", "blkb as").replace("bq as", "bqb as").replace("base as", "baseb as").replace("from fl)", "from bg)").replace("from pad,", "from padb,").replace("from blk)", "from blkb)").replace("join bq a", "join bqb a").replace("join bq b", "join bqb b")


@query("dff_windowed", f"""with {_LIST_SQL}, {_NORM_SQL}, fl as (select k, list_transform(c, lambda x: x * norm2) as c from tr join n using (k)), bg as (select k, list_transform(c, lambda x: x * 0.5 + 3) as c from tr join n using (k)), {_F_FILTER_SQL}, {_B_FILTER_SQL}
 select k, t, round((c[t + 1] - base.base) / (baseb.base + base.base), 6) + 0.0 as y from base join baseb using (k, t) join fl using (k)""")
def _(spark, sf):
    return _traces_of(traces.dff_windowed(v.traces(spark, sf), _norms(spark, sf), _background(spark, sf), 0.2, 16, 6), "k")


@query("extract_dff", f"""with {_GRAM_SQL}, {MOVIE_SQL}, {TRACE_SQL}, ay as (select k, t, sum(w * y) as v from foot join movie using (px) group by k, t),
 ot as (select k1 as k, t, sum(v * y) as o from gram join trace on k = k2 where k1 <> k2 group by 1, 2), lf as (select k, t, v - coalesce(o, 0) as x from ay left join ot using (k, t)),
 ls as (select k, list(x order by t) as w from lf group by k), d as (select k, {hazen_sql("w", 0.5)} as df from ls), mn as (select k, min(y) as base from trace group by k)
 select k, trace.t, round(df, 4) + 0.0 as df, round((y - base) * g.v / df, 4) + 0.0 as y from trace join mn using (k) join d using (k) join gram g on g.k1 = k and g.k2 = k""")
def _(spark, sf):
    foot, tr = v.footprints(spark, sf), v.traces(spark, sf)
    base = tr.select("k", F.array_min("c").alias("base"))
    d = traces.movie_dff(tr, foot, v.pixels(spark, sf), base, 0.5)
    return v.unpack(d, "k", "df", values="c").select("k", "t", (F.round("df", 4) + F.lit(0.0)).alias("df"), (F.round("y", 4) + F.lit(0.0)).alias("y"))


@query("remove_baseline", f"with {_LIST_SQL}, q as (select k, c, list_filter(c, lambda x, i: i > 1 and x - c[i - 1] >= 0 and x - c[i - 1] < 0.1) as a from tr), b as (select k, c, case when len(a) > 0 then {hazen_sql('a', 0.5)} else 0.0 end as base from q) select k, unnest(range(64)) as t, round(base, 6) + 0.0 as base, round(unnest(c) - base, 6) + 0.0 as y from b")
def _(spark, sf):
    d = traces.remove_baseline(v.traces(spark, sf), F.lit(0.1))
    return v.unpack(d, "k", "base", values="c").select("k", "t", r6(F.col("base")).alias("base"), r6(F.col("y")).alias("y"))


@query("event_detection", f"with {TRACE_SQL}, w as (select *, max(y) over f as top, min(y) over f as low from trace window f as (partition by k order by t rows between 5 preceding and 5 following)) select k, t, round(y, 6) + 0.0 as y from w where y = top and top - low >= 0.25")
def _(spark, sf):
    return traces.events(v.traces(spark, sf), 5, 0.25).select("k", "t", r6(F.col("y")).alias("y"))


@query("signal_extraction_baseline", f"with {_LIST_SQL}, s as (select k, list_sort(list_filter(c, lambda x: x > 0)) as s from tr) select k, round(list_sum(s[1 : greatest(1, floor(len(s) * 0.25)::int)]) / greatest(1, floor(len(s) * 0.25)::int), 6) + 0.0 as base from s")
def _(spark, sf):
    return traces.signal_baseline(v.traces(spark, sf)).select("k", r6(F.col("base")).alias("base"))


_COV_SQL = f"{TRACE_SQL}, m as (select k, t, y - avg(y) over (partition by k) as y from trace), cov as (select a.k, l.lag::int as lag, sum(a.y * b.y) / 64 as v from m a, range(3) l(lag), m b where b.k = a.k and b.t = a.t + l.lag group by 1, 2)"


@query("autocov_lags", f"with {_COV_SQL} select k, lag, round(v, 6) + 0.0 as v from cov")
def _(spark, sf):
    return traces.autocovariance(v.traces(spark, sf), 2).select("k", "lag", r6(F.col("v")).alias("v"))


_FIT_SQL = f"with {_COV_SQL}, p as (select k, max(v) filter (lag = 0) - 0.001 as a, max(v) filter (lag = 1) as b, max(v) filter (lag = 2) as c from cov group by k)"


@query("ar1_fit", f"{_FIT_SQL} select k, round(b / a, 6) + 0.0 as g1, 0.0::double as g2 from p")
def _(spark, sf):
    return traces.ar_fit(v.traces(spark, sf), 1, F.lit(0.001)).select("k", r6(F.col("g1")).alias("g1"), "g2")


@query("ar2_fit", f"{_FIT_SQL} select k, round(b * (a - c) / (a * a - b * b), 6) + 0.0 as g1, round((a * c - b * b) / (a * a - b * b), 6) + 0.0 as g2 from p")
def _(spark, sf):
    return traces.ar_fit(v.traces(spark, sf), 2, F.lit(0.001)).select("k", r6(F.col("g1")).alias("g1"), r6(F.col("g2")).alias("g2"))


@query("lambda_choice", "select g, sn, round(sn * sqrt((1 - pow(g, 2000.0)) / (1 - g * g)) * 2.3263478740408408, 6) + 0.0 as lam from (select p_size / 60.0::double as g, p_size / 10.0::double as sn from (select distinct p_size from part))")
def _(spark, sf):
    grid = v.read(spark, sf, "part").select((F.col("p_size") / F.lit(60.0)).alias("g"), (F.col("p_size") / F.lit(10.0)).alias("sn")).distinct()
    return traces.lambda_choice(grid, 0.99).select("g", "sn", r6(F.col("lam")).alias("lam"))


def _taus(spark, sf):
    return v.read(spark, sf, "part").select((F.col("p_size") + F.lit(1.0)).alias("tau_d"), ((F.col("p_size") + F.lit(1.0)) / 4).alias("tau_r")).distinct()


@query("exp2ar", "select tau_d, tau_r, round(exp(-1 / tau_d) + exp(-1 / tau_r), 6) + 0.0 as g1, round(-exp(-1 / tau_d) * exp(-1 / tau_r), 6) + 0.0 as g2 from (select distinct p_size + 1.0::double as tau_d, (p_size + 1.0::double) / 4 as tau_r from part)")
def _(spark, sf):
    return traces.exponentials_to_ar(_taus(spark, sf)).select("tau_d", "tau_r", r6(F.col("g1")).alias("g1"), r6(F.col("g2")).alias("g2"))


@query("ar2exp", "with g as (select distinct p_size, 0.5 + p_size / 40.0::double as g1, -0.2 - p_size / 100.0::double as g2 from part), q as (select *, g1 * g1 + 4 * g2 as d, (g1 + sqrt(greatest(g1 * g1 + 4 * g2, 0))) / 2 as a, (g1 - sqrt(greatest(g1 * g1 + 4 * g2, 0))) / 2 as b from g) select round(g1, 6) + 0.0 as g1, round(g2, 6) + 0.0 as g2, case when d >= 0 and a > 0 and a < 1 then round(-1 / ln(a), 6) + 0.0 end as tau_d, case when d >= 0 and b > 0 and b < 1 then round(-1 / ln(b), 6) + 0.0 end as tau_r from q")
def _(spark, sf):
    grid = v.read(spark, sf, "part").select("p_size").distinct().select((0.5 + F.col("p_size") / F.lit(40.0)).alias("g1"), (-0.2 - F.col("p_size") / F.lit(100.0)).alias("g2"))
    return traces.ar_to_exponentials(grid).select(*(r6(F.col(c)).alias(c) for c in ("g1", "g2", "tau_d", "tau_r")))


@query("tau_d2c", "select d, r, round(-0.1 / ln(r), 6) + 0.0 as tau_r, round(-0.1 / ln(d), 6) + 0.0 as tau_d from (select distinct p_size / 51.0::double as d, p_size / 102.0::double as r from part)")
def _(spark, sf):
    grid = v.read(spark, sf, "part").select((F.col("p_size") / F.lit(51.0)).alias("d"), (F.col("p_size") / F.lit(102.0)).alias("r")).distinct()
    return traces.discrete_to_continuous(grid, 0.1).select("d", "r", r6(F.col("tau_r")).alias("tau_r"), r6(F.col("tau_d")).alias("tau_d"))


@query("gen_ar1_trace", f"with {TRACE_SQL}, s as (select k, t, case when y > 0.2 then 1.0 else 0.0 end as s from trace) select a.k, a.t, round(sum(pow(0.9, a.t - b.t) * b.s), 6) + 0.0 as y from s a join s b on b.k = a.k and b.t <= a.t group by 1, 2")
def _(spark, sf):
    spikes = v.traces(spark, sf).select("k", F.transform("c", lambda x: F.when(x > 0.2, 1.0).otherwise(0.0)).alias("s"))
    return _traces_of(traces.ar1_response(spikes, 0.9), "k")
