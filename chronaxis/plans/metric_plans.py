"""Metrics of sequences, of series and of the battery: all layers in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronaxis.functions import stats
from chronaxis.functions import vectors as V
from chronaxis.operators import geometry, linalg, series
from chronaxis.plans import domain as D
from chronaxis.plans import literals
from chronaxis.plans import sql as S
from chronaxis.plans.linear_plans import DOT, on_axis
from chronaxis.plans.registry import Registry
from chronaxis.plans.series_plans import ORDINAL_SQL
from chronaxis.sources.tables import small

register = Registry()
SEQ = ["seq", "layer"]
METRICS = ("spearman_rho", "bw_ratio", "centroid_tau", "knn_purity", "tmpl_robustness", "cross_cosine", "cross_rho")


def bw_sql(source: str, keys: str) -> str:
    """``keys, bw`` of a long table ``keys, label, pos, v``."""
    return f"""(select {keys}, sum(k * (m - c) ** 2) / (sum(ss - k * m * m) + 1e-12) as bw from (select *, sum(s) over w / sum(k) over w as c from (
      select {keys}, label, pos, avg(v) as m, sum(v) as s, sum(v * v) as ss, count(*) as k from {source} group by all) window w as (partition by {keys}, pos)) group by {keys})"""


def near_sql(source: str, keys: str, key: str) -> str:
    """``keys, label, near`` of points ``keys, label, vec``."""
    return f"""(select {keys}, label, near from (select {keys}, a.label, b.label as near, row_number() over (partition by {keys}, {key.format("a")} order by round(list_distance(a.vec, b.vec), 9), {key.format("b")}) as r
      from {source} a join {source} b using ({keys}) where a.label <> b.label) where r = 1)"""


def tau_sql(source: str, keys: str) -> str:
    """``keys, tau`` of centroids ``keys, label, mid, vec``: distances in space against distances in time."""
    pairs = f"select {keys}, a.label * 1000 + b.label as id, round(list_distance(a.vec, b.vec), 9) as x, abs(a.mid - b.mid) as y from {source} a join {source} b using ({keys}) where a.label < b.label"
    signs = f"select {keys}, sign(a.x - b.x) as sx, sign(a.y - b.y) as sy from ({pairs}) a join ({pairs}) b using ({keys}) where a.id < b.id"
    return f"(select {keys}, sum(sx * sy) / nullif(sqrt(sum(abs(sx))::double * sum(abs(sy))), 0) as tau from ({signs}) group by {keys})"


def tau(centroids: DataFrame, keys: list[str]) -> DataFrame:
    apart = geometry.pair_distances(centroids, keys, "label", "mid").select(*keys, (F.col("i") * 1000 + F.col("j")).alias("id"), F.round("d_vec", 9).alias("d_vec"), "d_mid")
    return stats.kendall_tau(apart, keys, "d_vec", "d_mid", "id")


#: Two sequences: the even templates and the odd; cells with raw (``raw``) and standard values (``v``, ``vec``).
SEQ_SQL = f"""{D.LONG_SQL}, ax as {D.axis_sql("cell", "layer")}, sc as (select layer, tmpl % 2 as seq, tmpl, label, mid, pos, v as raw, (v - avg(v) over w) / case when stddev_pop(v) over w > 0 then stddev_pop(v) over w else 1 end as v from cell window w as (partition by layer, tmpl % 2, pos)),
sv as (select layer, seq, tmpl, label, mid, list(v order by pos) as vec, list(raw order by pos) as raw from sc group by all), {S.axes_sql("q", "sc", "seq, layer", "tmpl, label", 2)}, bwr as {bw_sql("sc", "seq, layer")}"""
METRIC_SQL = f"""{SEQ_SQL}, q1 as (select seq, layer, mid, {DOT("vec", "axis")} as p from sv join qax using (seq, layer) where c = 0), r1 as {D.spearman_sql("q1", "seq, layer", "p", "mid")},
q2 as (select seq, layer, mid, {DOT("raw", "axis")} as p from sv join ax using (layer)), r2 as (select seq, layer, rho as cross_rho from {D.spearman_sql("q2", "seq, layer", "p", "mid")}),
cl as (select seq, layer, label, mid, pos, avg(v) as v from sc group by all), cc as (select seq, layer, label, mid, list(v order by pos) as vec from cl group by all), tt as {tau_sql("cc", "seq, layer")}, nr as {near_sql("sv", "seq, layer", "{0}.label * 100 + {0}.tmpl")},
pu as (select seq, layer, avg((abs(label - near) = 1)::int) as purity from nr group by all),
ro as (select seq, layer, avg(r) as robustness from (select seq, layer, label, sqrt(sum(s * s)) as r from (select seq, layer, label, pos, stddev_pop(raw) as s from sc group by all having count(*) >= 2) group by all) group by all),
co as (select seq, layer, abs({DOT("q.axis", "a.axis")} / (sqrt({DOT("q.axis", "q.axis")}) * sqrt({DOT("a.axis", "a.axis")}) + 1e-12)) as cosine from qax q join ax a using (layer) where c = 0),
mt as (select seq, layer, n, abs(rho) as spearman_rho, bw as bw_ratio, tau as centroid_tau, purity as knn_purity, robustness as tmpl_robustness, cosine as cross_cosine, cross_rho from r1 join r2 using (seq, layer) join bwr using (seq, layer) join tt using (seq, layer) join pu using (seq, layer) join ro using (seq, layer) join co using (seq, layer))"""


def sequence_cells(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(cells of both sequences as they are, the same in standard scores by sequence and layer)."""
    raw = D.cells(spark, sf).withColumns({"seq": F.col("tmpl") % 2, "id": F.col("label") * 100 + F.col("tmpl")})
    long = V.scaled(V.spread(raw, "vec"), SEQ)
    return raw, V.gather(long, [*SEQ, "tmpl", "label", "mid", "id"], "v")


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    """``seq, layer, n`` and the seven metrics."""
    raw, scaled = sequence_cells(spark, sf)
    long = V.spread(scaled, "vec")
    year = D.difference_axis(D.cells(spark, sf), ["layer"]).withColumnRenamed("axis", "year_axis")
    pc1 = linalg.first_component(scaled, SEQ, "mid")
    made = stats.spearman(on_axis(scaled, pc1, SEQ), SEQ, "p", "mid", rho="spearman_rho").withColumn("spearman_rho", F.abs("spearman_rho"))
    made = made.join(geometry.bw_ratio(long, SEQ, "label").withColumnRenamed("bw", "bw_ratio"), SEQ)
    made = made.join(tau(V.centroids(scaled, [*SEQ, "label", "mid"], "vec"), SEQ).withColumnRenamed("tau", "centroid_tau"), SEQ)
    made = made.join(geometry.purity(geometry.nearest(scaled, SEQ, "label", "id"), SEQ, "label").drop("n").withColumnRenamed("purity", "knn_purity"), SEQ)
    made = made.join(geometry.robustness(V.spread(raw.select(*SEQ, "label", "vec"), "vec"), SEQ, "label").withColumnRenamed("robustness", "tmpl_robustness"), SEQ)
    made = made.join(pc1.join(small(year), "layer").select(*SEQ, F.abs(V.cosine(F.col("axis"), F.col("year_axis"))).alias("cross_cosine")), SEQ)
    return made.join(stats.spearman(on_axis(raw, year, ["layer"], axis="year_axis"), SEQ, "p", "mid", rho="cross_rho").drop("n"), SEQ)


@register(f"with recursive {METRIC_SQL} select seq, layer, n, {', '.join(S.r6(m, m) for m in METRICS)} from mt")
def sequence_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Seven metrics by sequence and layer; principal axes, ratio, tau and neighbours on standard scores, the rest on raw vectors."""
    return D.rounded(metrics(spark, sf), *METRICS)


def best_layers(spark: SparkSession, sf: str) -> DataFrame:
    """``seq, layer, bw`` of the layer with the greatest ratio; the first wins a tie."""
    bw = geometry.bw_ratio(V.spread(sequence_cells(spark, sf)[1], "vec"), SEQ, "label")
    return bw.groupBy("seq").agg(F.min(F.struct((-F.round("bw", 9)).alias("r"), "layer", "bw")).alias("b")).select("seq", "b.layer", "b.bw")


BEST_SQL = "bl as (select seq, layer, bw from (select *, row_number() over (partition by seq order by round(bw, 9) desc, layer) as r from bwr) where r = 1)"

_KEYS = ["tmpl", "layer"]
_MANIFOLD_SQL = f"""{D.LONG_SQL}, ax as {D.axis_sql("cell", "layer")}, {S.axes_sql("q", "cell", "tmpl, layer", "label", 1)}, q1 as (select tmpl, layer, mid, {DOT("vec", "axis")} as p from cvec join qax using (tmpl, layer)), r1 as {D.spearman_sql("q1", "tmpl, layer", "p", "mid")},
q2 as (select tmpl, layer, mid, {DOT("vec", "axis")} as p from cvec join ax using (layer)), r2 as (select tmpl, layer, rho as cross_rho from {D.spearman_sql("q2", "tmpl, layer", "p", "mid")}), tt as {tau_sql("cvec", "tmpl, layer")},
nr as {near_sql("cvec", "tmpl, layer", "{0}.label")}, pu as (select tmpl, layer, avg((abs(label - near) = 1)::int) as purity from nr group by all),
co as (select tmpl, layer, abs({DOT("q.axis", "a.axis")} / (sqrt({DOT("q.axis", "q.axis")}) * sqrt({DOT("a.axis", "a.axis")}) + 1e-12)) as cross_cosine from qax q join ax a using (layer))"""


@register(
    f"""with recursive {_MANIFOLD_SQL} select tmpl, layer, {S.r6("abs(rho)", "spearman_rho")}, n, {S.r6("tau", "tau")}, {S.r6("purity", "purity")}, {S.r6("cross_cosine", "cross_cosine")}, {S.r6("cross_rho", "cross_rho")}
    from r1 join r2 using (tmpl, layer) join tt using (tmpl, layer) join pu using (tmpl, layer) join co using (tmpl, layer)"""
)
def manifold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """By template (a series of periods) and layer: first-component correlation, tau of distances, purity, correlation and cosine with the year axis."""
    cells = D.cells(spark, sf)
    pc1 = linalg.first_component(cells, _KEYS, "mid")
    year = D.difference_axis(cells, ["layer"]).withColumnRenamed("axis", "year_axis")
    rho = stats.spearman(on_axis(cells, pc1, _KEYS), _KEYS, "p", "mid", rho="spearman_rho").withColumn("spearman_rho", F.abs("spearman_rho"))
    cross = stats.spearman(on_axis(cells, year, ["layer"], axis="year_axis"), _KEYS, "p", "mid", rho="cross_rho").drop("n")
    near = geometry.purity(geometry.nearest(cells.withColumn("id", F.col("label")), _KEYS, "label", "id"), _KEYS, "label").drop("n")
    cosine = pc1.join(small(year), "layer").select(*_KEYS, F.abs(V.cosine(F.col("axis"), F.col("year_axis"))).alias("cross_cosine"))
    made = rho.join(tau(cells, _KEYS), _KEYS).join(near, _KEYS).join(cosine, _KEYS).join(cross, _KEYS)
    return D.rounded(made, "spearman_rho", "tau", "purity", "cross_cosine", "cross_rho")


STARS = "case when {p} < 0.001 then '***' when {p} < 0.01 then '**' when {p} < 0.05 then '*' else '' end".format
#: The year path by layer (``pl`` long, ``pv`` vectors), its first component and the battery's ordinals on the path's steps.
PATH_AXIS_SQL = f"""{D.PATH_SQL}, pv as (select l.layer, year, (i - 1)::int as step, vec[l.layer * 16 + 1 : l.layer * 16 + 16] as vec from num, (select unnest(range(4))::int as layer) l), pl as (select layer, year, step, unnest(range(16)) as pos, unnest(vec) as v from pv)"""
BATTERY_SQL = f"""{ORDINAL_SQL.replace("generate_series(-5, 70, 5)", "generate_series(0, 50, 1)")}, {PATH_AXIS_SQL}, {S.axes_sql("p", "pl", "layer", "year", 1)}, {S.risen_sql("p", "pv", "layer", "year")},
px as (select layer, step, {DOT("vec", "axis")} as p1 from pv join pup using (layer)), bo as (select series, layer, p1, ordinal from px join o on o.year = step where ordinal is not null),
bt as (select *, {S.p_sql("rho", "n")} as p from {D.spearman_sql("bo", "series, layer", "p1", "ordinal", 5)} where n >= 5)"""


def year_path(spark: SparkSession, sf: str) -> DataFrame:
    """``layer, year, step, vec``; the years are few by nature, so one window numbers them."""
    path = D.trajectory(spark, sf).drop("series").withColumn("step", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("year")) - 1)
    return D.layers(path)


def battery(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores of the path's steps on each layer's first component, ordinals of the interval series, their correlations)."""
    path = year_path(spark, sf)
    scores = on_axis(path, linalg.first_component(path, ["layer"], "year"), ["layer"], "p1").select("layer", "year", "step", "p1")
    own = series.ordinals(literals.periods(spark), literals.year_grid(spark, 0, 50, 1)).filter("ordinal is not null")
    made = stats.spearman(scores.select("layer", F.col("step").alias("year"), "p1").join(F.broadcast(own), "year"), ["series", "layer"], "p1", "ordinal", least=5).filter("n >= 5")
    return scores, own, made.withColumn("p", stats.p_value("rho", "n"))


@register(f"with recursive {BATTERY_SQL} select series, layer, {S.r6('rho', 'rho')}, n, {S.r6('p', 'p')}, {STARS(p='p')} as sig from bt")
def battery_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Ordinals of interval series against the first component of the year path; series of under five years go."""
    made = battery(spark, sf)[2]
    return D.rounded(made.withColumn("sig", stats.stars_battery(F.col("p"))), "rho", "p")
