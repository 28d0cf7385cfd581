"""Queries on vectors: axes, projections, geometry, sweeps over layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronaxis.functions import stats
from chronaxis.functions import vectors as V
from chronaxis.operators import geometry, probes
from chronaxis.plans import domain as D
from chronaxis.plans import literals
from chronaxis.plans.registry import Registry
from chronaxis.sources.tables import driver_table, small

register = Registry()
_DOT = "list_dot_product({}, {})".format
AXIS_SQL = f"{D.LONG_SQL}, ax as {D.axis_sql('cell', 'layer')}"
PROJ_SQL = f"{AXIS_SQL}, proj as (select c.layer, c.tmpl, c.label, c.mid, list_dot_product(c.vec, a.axis) as p from cvec c join ax a using (layer))"
LABEL_SQL = f"{D.POINTS_SQL}, lc as (select label, mid, list(v order by pos) as vec from (select label, mid, pos, avg(v) as v from (select label, mid, unnest(range(64)) as pos, unnest(vec) as v from pts) group by all) group by all)"
PAIR_SQL = f"{LABEL_SQL}, pr as (select a.label as i, b.label as j, list_distance(a.vec, b.vec) as d_vec, abs(a.mid - b.mid)::double as d_mid from lc a join lc b on a.label < b.label)"
_NEAR_SQL = f"""{D.POINTS_SQL}, nn as (select vec_id, label, near from (select a.vec_id, a.label, b.label as near, row_number() over (partition by a.vec_id order by round(list_distance(a.vec, b.vec), 9), b.vec_id) as r
  from pts a join pts b on a.label <> b.label) where r = 1)"""


def projected(spark: SparkSession, sf: str) -> DataFrame:
    """Cells on their layer's axis."""
    cells = D.cells(spark, sf)
    return cells.join(small(D.difference_axis(cells, ["layer"])), "layer").withColumn("p", V.dot(F.col("vec"), F.col("axis")))


def label_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return V.centroids(D.points(spark, sf), ["label", "mid"], "vec")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.pair_distances(label_centroids(spark, sf), [], "label", "mid")


@register(f"with {D.LONG_SQL} select layer, label, pos, round(round(avg(v), 9), 6) + 0.0 as m from long group by all")
def centroids(spark: SparkSession, sf: str) -> DataFrame:
    made = V.centroids(D.layers(D.points(spark, sf)), ["layer", "label"], "vec")
    return D.rounded(made.select("layer", "label", F.posexplode("vec").alias("pos", "m")), "m")


@register(f"with {AXIS_SQL} select layer, unnest(range(16))::int as pos, round(round(unnest(axis), 9), 6) + 0.0 as v from ax")
def mean_diff_axis(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(D.difference_axis(D.cells(spark, sf), ["layer"]).select("layer", F.posexplode("axis").alias("pos", "v")), "v")


@register(f"with {PROJ_SQL} select layer, tmpl, label, round(round(p, 9), 6) + 0.0 as p, round(round(exp(p), 9), 6) + 0.0 as exp_p from proj")
def projection(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(projected(spark, sf).select("layer", "tmpl", "label", "p", F.exp("p").alias("exp_p")), "p", "exp_p")


@register(
    f"""with {AXIS_SQL}, k as (select c.layer, c.tmpl, c.label, {_DOT('c.vec', 'a.axis')} / (sqrt({_DOT('c.vec', 'c.vec')}) * sqrt({_DOT('a.axis', 'a.axis')}) + 1e-12) as cos from cvec c join ax a using (layer))
    select layer, tmpl, label, {"round(round(cos, 9), 6) + 0.0 as cosine"}, round(round(degrees(acos(least(abs(cos), 1))), 9), 6) + 0.0 as angle, case when degrees(acos(least(abs(cos), 1))) > 70 then 'mostly orthogonal' else 'related' end as verdict from k"""
)
def cosine_angle(spark: SparkSession, sf: str) -> DataFrame:
    made = projected(spark, sf).withColumn("cosine", V.cosine(F.col("vec"), F.col("axis"))).withColumn("angle", V.angle(F.col("cosine")))
    return D.rounded(made.select("layer", "tmpl", "label", "cosine", "angle", F.when(F.col("angle") > 70, "mostly orthogonal").otherwise("related").alias("verdict")), "cosine", "angle")


@register(
    f"""with {D.LONG_SQL}, s as (select *, avg(v) over w as m, stddev_pop(v) over w as sd from long window w as (partition by layer, pos))
    select layer, label, round(round(avg(z), 9), 6) + 0.0 as mean_z, round(round(stddev_pop(z), 9), 6) + 0.0 as sd_z from (select layer, label, (v - m) / case when sd > 0 then sd else 1 end as z from s) group by all"""
)
def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    scaled = V.scaled(V.spread(D.layers(D.points(spark, sf)).select("layer", "label", "vec"), "vec"), ["layer"])
    return D.rounded(scaled.groupBy("layer", "label").agg(F.avg("v").alias("mean_z"), F.stddev_pop("v").alias("sd_z")), "mean_z", "sd_z")


@register("select vec_id, len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) = 0 as finite, sqrt(list_dot_product(embedding::double[], embedding::double[])) > 200 as large, round(round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 9), 6) + 0.0 as size from embeddings")
def vector_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    finite, large = V.diagnostics(F.col("embedding"))
    return D.rounded(driver_table(spark, sf, "embeddings").select("vec_id", finite.alias("finite"), large.alias("large"), V.norm(F.col("embedding")).alias("size")), "size")


@register(f"with {PAIR_SQL} select i, j, round(round(d_vec, 9), 6) + 0.0 as d_vec, d_mid from pr")
def pair_distance(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(pairs(spark, sf), "d_vec")


@register(
    f"""with {PAIR_SQL}, q as (select i * 1000 + j as id, round(d_vec, 9) as x, d_mid as y from pr), s as (select sign(a.x - b.x) as sx, sign(a.y - b.y) as sy from q a join q b on a.id < b.id)
    select round(round(sum(sx * sy) / nullif(sqrt(sum(abs(sx))::double * sum(abs(sy))), 0), 9), 6) + 0.0 as tau from s"""
)
def kendall_centroid_tau(spark: SparkSession, sf: str) -> DataFrame:
    distances = pairs(spark, sf).select((F.col("i") * 1000 + F.col("j")).alias("id"), F.round("d_vec", 9).alias("d_vec"), "d_mid")
    return D.rounded(stats.kendall_tau(distances, [], "d_vec", "d_mid", "id"), "tau")


@register(f"with {PAIR_SQL} select round(regr_slope(d_vec, d_mid), 9) + 0.0 as slope, round(round(regr_intercept(d_vec, d_mid), 9), 6) + 0.0 as intercept, count(*) as n from pr")
def centroid_trend(spark: SparkSession, sf: str) -> DataFrame:
    made = stats.ols(pairs(spark, sf).withColumn("g", F.lit(0)), ["g"], "d_mid", "d_vec")
    return D.rounded(made.select((F.round("slope", 9) + 0.0).alias("slope"), "intercept", "n"), "intercept")


@register(
    f"""with {D.LONG_SQL}, b as (select layer, label, pos, avg(v) as m, sum(v) as s, sum(v * v) as ss, count(*) as k from long group by all),
    c as (select *, sum(s) over w / sum(k) over w as c from b window w as (partition by layer, pos))
    select layer, round(round(sum(k * (m - c) ** 2) / (sum(ss - k * m * m) + 1e-12), 9), 6) + 0.0 as bw from c group by layer"""
)
def bw_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(geometry.bw_ratio(V.spread(D.layers(D.points(spark, sf)).select("layer", "label", "vec"), "vec"), ["layer"], "label"), "bw")


@register(f"with {_NEAR_SQL} select round(round(avg((abs(label - near) = 1)::int), 9), 6) + 0.0 as purity, count(*) as n from nn")
def knn_purity(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(geometry.purity(geometry.nearest(D.points(spark, sf), [], "label", "vec_id"), [], "label"), "purity")


@register(f"with {_NEAR_SQL} select label, near, round(round(count(*) / sum(count(*)) over (partition by label), 9), 6) + 0.0 as share from nn group by label, near")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(geometry.confusion(geometry.nearest(D.points(spark, sf), [], "label", "vec_id"), [], "label"), "share")


@register(
    f"""with {D.LONG_SQL}, e as (select layer, label, pos, stddev_pop(v) as s, count(*) as k from cell group by all having count(*) >= 2)
    select layer, round(round(avg(r), 9), 6) + 0.0 as robustness from (select layer, label, sqrt(sum(s * s)) as r from e group by all) group by layer"""
)
def template_robustness(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(geometry.robustness(V.spread(D.cells(spark, sf).select("layer", "label", "vec"), "vec"), ["layer"], "label"), "robustness")


@register(f"with {D.PATH_SQL} select 'all' as series, (a.year + b.year) / 2 as at, round(list_distance(a.vec, b.vec) / abs(b.year - a.year), 9) + 0.0 as velocity from num a join num b on b.i = a.i + 1")
def velocity(spark: SparkSession, sf: str) -> DataFrame:
    made = geometry.velocity(D.trajectory(spark, sf), ["series"], "year")
    return made.withColumn("velocity", F.round("velocity", 9) + 0.0)


@register(
    f"""with {D.PATH_SQL}, st as (select a.year, list_transform(list_zip(a.vec, z.vec), lambda t: t[1] - t[2]) as u, list_transform(list_zip(b.vec, a.vec), lambda t: t[1] - t[2]) as v from num a join num z on z.i = a.i - 1 join num b on b.i = a.i + 1)
    select 'all' as series, year, round(round(degrees(acos(greatest(least({_DOT('u', 'v')} / (sqrt({_DOT('u', 'u')}) * sqrt({_DOT('v', 'v')}) + 1e-12), 1), -1))), 9), 6) + 0.0 as curvature from st"""
)
def curvature(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(geometry.curvature(D.trajectory(spark, sf), ["series"], "year"), "curvature")


@register(
    f"""with {D.PATH_SQL}, s as (select c.year, r.i, unnest(range(64)) as pos, unnest(r.vec) as v from num c join num r on r.i between c.i - 4 and c.i + 4 where c.i > 4 and c.i <= c.n - 4),
    z as (select year, i, list(d order by pos) as x from (select year, i, pos, v - avg(v) over (partition by year, pos) as d from s) group by all),
    g as (select a.year, a.i = b.i as own, {_DOT('a.x', 'b.x')} as g from z a join z b on a.year = b.year)
    select 'all' as series, year, round(round(case when sum(g) filter (own) <= 1e-12 then 1 else (sum(g) filter (own)) ** 2 / sum(g * g) end, 9), 6) + 0.0 as dimension from g group by year"""
)
def local_dim(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(geometry.local_dimension(D.trajectory(spark, sf), ["series"], "year"), "dimension")


_CLUSTER_SQL = f"""{D.LONG_SQL}, cp as (select tmpl * 100 + label as id, tmpl % 3 as series, mid, vec from cvec where layer = 0), g as (select unnest(generate_series(1200, 1875, 75))::int as year),
met as (select g.year, id, series, vec, abs(mid - g.year) as gap from cp, g), nr as (select * from met where gap <= 75), fr as (select * from met where gap > 150),
cn as (select year, count(distinct series) as n_series, count(*) as n_periods from nr group by year), fn as (select year, count(*) as n_far from fr group by year),
wi as (select a.year, avg(list_distance(a.vec, b.vec)) as within from nr a join nr b on a.year = b.year and a.id < b.id group by a.year),
be as (select a.year, avg(list_distance(a.vec, b.vec)) as between_ from nr a join fr b on a.year = b.year group by a.year),
cl as (select g.year, case when n_periods >= 2 then n_series else 0 end as n_series, case when n_periods >= 2 then n_periods else 0 end as n_periods, case when n_periods >= 2 then within end as within, case when n_periods >= 2 and n_far >= 2 then between_ end as between_
  from g left join cn using (year) left join fn using (year) left join wi using (year) left join be using (year))"""


def _clustered(spark: SparkSession, sf: str) -> DataFrame:
    pts = D.cells(spark, sf).filter("layer = 0").select((F.col("tmpl") * 100 + F.col("label")).alias("id"), (F.col("tmpl") % 3).alias("series"), "mid", "vec")
    return geometry.clustering(pts, literals.year_grid(spark, 1200, 1875, 75), "series", "mid", "id").withColumnRenamed("between", "between_")


@register(f"with {_CLUSTER_SQL} select year, n_series, n_periods, round(round(within, 9), 6) + 0.0 as within, round(round(between_, 9), 6) + 0.0 as between_ from cl")
def cross_group_clustering(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(_clustered(spark, sf), "within", "between_")


@register(f"with {_CLUSTER_SQL} select year, round(round(between_ / within, 9), 6) + 0.0 as ratio from cl where n_series >= 2 and within is not null and between_ is not null")
def separation_ratio(spark: SparkSession, sf: str) -> DataFrame:
    made = _clustered(spark, sf).filter("n_series >= 2").dropna(subset=["within", "between_"])
    return D.rounded(made.select("year", F.try_divide("between_", "within").alias("ratio")), "ratio")


@register(f"with {LABEL_SQL} select label, mid, (row_number() over (order by mid, label) - 1)::int as pid from lc")
def temporal_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Periods are few by nature, so one window orders them."""
    periods = D.points(spark, sf).select("label", "mid").distinct()
    return periods.withColumn("pid", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("mid", "label")) - 1)


SWEEP_SQL = f"{PROJ_SQL}, sweep as {D.spearman_sql('proj', 'layer, tmpl', 'p', 'mid')}"


def sweep(spark: SparkSession, sf: str) -> DataFrame:
    return stats.spearman(projected(spark, sf), ["layer", "tmpl"], "p", "mid")


@register(f"with {SWEEP_SQL} select layer, tmpl, round(round(rho, 9), 6) + 0.0 as rho, n from sweep")
def layer_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(sweep(spark, sf), "rho")


@register(f"with {SWEEP_SQL} select tmpl, layer as best_layer, round(round(rho, 9), 6) + 0.0 as rho from (select *, row_number() over (partition by tmpl order by round(rho, 9) desc, layer) as r from sweep where rho is not null) where r = 1")
def layer_sweep_best(spark: SparkSession, sf: str) -> DataFrame:
    best = F.min(F.struct((-F.round("rho", 9)).alias("r"), "layer"))
    return D.rounded(sweep(spark, sf).filter("rho is not null").groupBy("tmpl").agg(best.alias("b")).select("tmpl", F.col("b.layer").alias("best_layer"), (-F.col("b.r")).alias("rho")), "rho")


@register(f"with {SWEEP_SQL} select tmpl, " + ", ".join(f"round(round(max(rho) filter (layer = {k}), 9), 6) + 0.0 as rho_{k}, max(n) filter (layer = {k}) as n_{k}" for k in range(D.LAYERS)) + " from sweep group by tmpl")
def pivot_layers(spark: SparkSession, sf: str) -> DataFrame:
    made = sweep(spark, sf).groupBy("tmpl").pivot("layer", list(range(D.LAYERS))).agg(F.first("rho").alias("rho"), F.first("n").alias("n"))
    return D.rounded(made.select("tmpl", *[F.col(f"{k}_{c}").alias(f"{c}_{k}") for k in range(D.LAYERS) for c in ("rho", "n")]), *[f"rho_{k}" for k in range(D.LAYERS)])


@register(f"with {SWEEP_SQL} select layer, round(round(avg(abs(rho)), 9), 6) + 0.0 as mean_abs_rho from sweep group by layer")
def mean_abs_by_layer(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(sweep(spark, sf).groupBy("layer").agg(F.avg(F.abs("rho")).alias("mean_abs_rho")), "mean_abs_rho")


_CROSS_SQL = f"""{D.LONG_SQL}, half as (select layer, tmpl % 2 as h, label, mid, pos, avg(v) as v from cell group by all), hv as (select layer, h, label, mid, list(v order by pos) as vec from half group by all),
hx as {D.axis_sql('half', 'layer, h')}, met as (select v.layer, v.h, v.mid, {_DOT('v.vec', 'x.axis')} as p from hv v join hx x on x.layer = v.layer and x.h <> v.h),
rh as {D.spearman_sql('met', 'layer, h', 'p', 'mid')}"""


@register(
    f"""with {_CROSS_SQL} select a.layer, round(round({_DOT('a.axis', 'b.axis')}, 9), 6) + 0.0 as cosine, round(round(r.rho, 9), 6) + 0.0 as rho_seq_on_yr, round(round(s.rho, 9), 6) + 0.0 as rho_yr_on_seq
    from hx a join hx b on a.layer = b.layer and a.h = 0 and b.h = 1 join rh r on r.layer = a.layer and r.h = 1 join rh s on s.layer = a.layer and s.h = 0"""
)
def cross_temporal(spark: SparkSession, sf: str) -> DataFrame:
    """The even templates' axis (years) against the odd templates' (a sequence), for each layer."""
    halves = V.centroids(D.cells(spark, sf).withColumn("h", F.col("tmpl") % 2), ["layer", "h", "label", "mid"], "vec")
    axes = D.difference_axis(halves, ["layer", "h"])
    other = small(axes.select("layer", (1 - F.col("h")).alias("h"), "axis"))
    rho = stats.spearman(halves.join(other, ["layer", "h"]).withColumn("p", V.dot(F.col("vec"), F.col("axis"))), ["layer", "h"], "p", "mid")
    at = lambda df, h, c, name: df.filter(F.col("h") == h).select("layer", F.col(c).alias(name))
    both = at(axes, 0, "axis", "a").join(at(axes, 1, "axis", "b"), "layer").select("layer", V.dot(F.col("a"), F.col("b")).alias("cosine"))
    made = both.join(at(rho, 1, "rho", "rho_seq_on_yr"), "layer").join(at(rho, 0, "rho", "rho_yr_on_seq"), "layer")
    return D.rounded(made, "cosine", "rho_seq_on_yr", "rho_yr_on_seq")


@register(
    f"""with {SWEEP_SQL}, b as (select tmpl, layer, label, pos, avg(v) as m, sum(v) as s, sum(v * v) as ss, count(*) as k from long group by all), c as (select *, sum(s) over w / sum(k) over w as c from b window w as (partition by tmpl, layer, pos)),
    bw as (select tmpl, layer, sum(k * (m - c) ** 2) / (sum(ss - k * m * m) + 1e-12) as bw from c group by all), t as (select tmpl, max(coalesce(abs(rho), 0)) as best_rho, max(abs(bw)) as bw from sweep join bw using (tmpl, layer) group by tmpl)
    select tmpl, round(round(best_rho, 9), 6) + 0.0 as best_rho, round(round(bw / (max(bw) over () + 1e-9), 9), 6) + 0.0 as bw_scaled from t"""
)
def composite_scores(spark: SparkSession, sf: str) -> DataFrame:
    long = V.spread(D.layers(D.points(spark, sf)).select("tmpl", "layer", "label", "vec"), "vec")
    made = sweep(spark, sf).join(geometry.bw_ratio(long, ["tmpl", "layer"], "label"), ["tmpl", "layer"]).groupBy("tmpl").agg(F.max(F.coalesce(F.abs("rho"), F.lit(0.0))).alias("best_rho"), F.max(F.abs("bw")).alias("bw"))
    top = made.agg(F.max("bw").alias("top"))
    return D.rounded(made.crossJoin(F.broadcast(top)).select("tmpl", "best_rho", (F.col("bw") / (F.col("top") + 1e-9)).alias("bw_scaled")), "best_rho", "bw_scaled")


@register("select 'vec ' || vec_id as text, label from embeddings")
def embed_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Texts met with precomputed vectors; a missing one would be an error."""
    table = driver_table(spark, sf, "embeddings").select(F.concat(F.lit("vec "), "vec_id").alias("text"), "label", "embedding", "vec_id")
    return probes.embed_from_table(table.select("text"), table).select("text", "label")
