"""Queries on principal axes, least-norm axes, scaling and peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronaxis.functions import stats
from chronaxis.functions import vectors as V
from chronaxis.operators import geometry, linalg
from chronaxis.plans import domain as D
from chronaxis.plans import sql as S
from chronaxis.plans import vector_plans as P
from chronaxis.plans.registry import Registry
from chronaxis.sources.tables import small

register = Registry()
DOT = "list_dot_product({}, {})".format


def on_axis(points: DataFrame, axes: DataFrame, keys: list[str], name: str = "p", axis: str = "axis") -> DataFrame:
    """``points`` with their projection; one axis a key, so a small table unless there are very many series."""
    return points.join(small(axes), keys).withColumn(name, V.dot(F.col("vec"), F.col(axis))).drop(axis)


_PC1_SQL = f"{D.LONG_SQL}, {S.axes_sql('p', 'cell', 'layer', 'tmpl, label', 1)}, {S.risen_sql('p', 'cvec', 'layer', 'mid')}, pp as (select layer, mid, {DOT('vec', 'axis')} as p from cvec join pup using (layer)), pr as {D.spearman_sql('pp', 'layer', 'p', 'mid')}"


@register(f"with recursive {_PC1_SQL} select layer, unnest(range(16))::int as pos, {S.r6('unnest(axis)', 'v')}, {S.r6('rho', 'rho')}, n from pup join pr using (layer)")
def pc1_axis(spark: SparkSession, sf: str) -> DataFrame:
    """First component by layer, turned to rise with time, and the rank correlation of its scores."""
    cells = D.cells(spark, sf)
    axes = linalg.first_component(cells, ["layer"], "mid")
    made = axes.join(stats.spearman(on_axis(cells, axes, ["layer"]), ["layer"], "p", "mid"), "layer")
    return D.rounded(made.select("layer", F.posexplode("axis").alias("pos", "v"), "rho", "n"), "v", "rho")


@register(
    f"""with recursive {D.LONG_SQL}, {S.axes_sql('p', 'cell', 'layer', 'tmpl, label', 3, 'tmpl % 2 = 0')}, {S.weighed_sql('p', 'layer')}, s as ({S.scores_sql('p', 'cvec', 'layer', 'tmpl * 100 + label as id')})
    select layer, id, component, {S.r6('score', 'score')}, {S.r6('share', 'share')} from s"""
)
def pca_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Three components fitted on the even templates; the odd ones are projected into their space."""
    cells = D.cells(spark, sf).withColumns({"id": F.col("tmpl") * 100 + F.col("label"), "fit": F.col("tmpl") % 2 == 0})
    return D.rounded(linalg.component_scores(cells, ["layer"], "id", k=3, fitted="fit"), "score", "share")


#: Vectors of labels by layer, the target, and the least-norm direction by the dual form (ten labels in sixteen dimensions).
MINNORM_SQL = f"""{D.LONG_SQL}, ll as (select layer, label, pos, avg(v) as v from long group by all), lc as (select layer, label, list(v - mu order by pos) as x from (select *, avg(v) over (partition by layer, pos) as mu from ll) group by all),
lv as (select layer, label, list(v order by pos) as vec from ll group by all), ly as (select layer, label, x, ln(1 + label) as target, ln(1 + label) - avg(ln(1 + label)) over (partition by layer) as y from lc),
lg as (select layer, a.label, any_value(a.y) as y, list({DOT('a.x', 'b.x')} + 1 order by b.label) as g from ly a join ly b using (layer) group by layer, a.label), lm as (select layer, list(list_append(g, y) order by label) as m from lg group by layer),
{S.solve_sql('n', 'lm', 'layer', 10)}, na as (select layer, label, x[row_number() over (partition by layer order by label)] as w from nx join (select layer, label from ly) using (layer)),
nd as (select layer, pos, sum(w * v) as d from na join (select layer, label, unnest(range(16)) as pos, unnest(x) as v from ly) using (layer, label) group by all), nq as (select *, d / (sqrt(sum(d * d) over (partition by layer)) + 1e-12) as v from nd),
nax as (select layer, list(v order by pos) as axis from nq group by layer)"""


def value_axis(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(centroids of labels by layer with their target, the least-norm axis by layer)."""
    made = V.centroids(D.layers(D.points(spark, sf)), ["layer", "label"], "vec").withColumn("target", F.ln(1.0 + F.col("label")))
    return made, linalg.min_norm_axis(made, ["layer"], "target")


@register(f"with recursive {MINNORM_SQL} select layer, pos::int as pos, {S.r6('v', 'v')} from nq")
def minnorm_axis(spark: SparkSession, sf: str) -> DataFrame:
    """Direction of log value over period centroids, by layer."""
    return D.rounded(value_axis(spark, sf)[1].select("layer", F.posexplode("axis").alias("pos", "v")), "v")


def mds_sql(p: str, source: str, keys: str, ids: str) -> str:
    """CTEs ``{p}xy (keys, ids, x, y)`` and ``{p}st (keys, stress)`` of a long table: components of standard scores, each with its largest coordinate positive."""
    id_list = ids.split(", ")
    pair = " or ".join(f"(a.{i} < b.{i}" + "".join(f" and a.{j} = b.{j}" for j in id_list[:k]) + ")" for k, i in enumerate(id_list))
    return f"""{p}z as (select {keys}, {ids}, pos, (v - avg(v) over w) / case when stddev_pop(v) over w > 0 then stddev_pop(v) over w else 1 end as v from {source} window w as (partition by {keys}, pos)),
    {p}zv as (select {keys}, {ids}, list(v order by pos) as vec from {p}z group by all), {S.axes_sql(p, p + 'z', keys, ids, 2)},
    {p}s as (select {keys}, {ids}, c, {DOT('vec', 'axis')} as s from {p}zv join {p}ax using ({keys})),
    {p}t as (select *, s * case when first_value(s) over (partition by {keys}, c order by round(abs(s), 9) desc, {ids}) < 0 then -1 else 1 end as q from {p}s),
    {p}xy as (select {keys}, {ids}, max(q) filter (c = 0) as x, max(q) filter (c = 1) as y from {p}t group by all),
    {p}full as (select * from {p}zv join {p}xy using ({keys}, {ids})),
    {p}st as (select {keys}, sum((list_distance(a.vec, b.vec) - sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) ** 2) as stress from {p}full a join {p}full b using ({keys}) where {pair} group by {keys})"""


@register(
    f"""with recursive {P.LABEL_SQL}, ll as (select 0 as g, label, unnest(range(64)) as pos, unnest(vec) as v from lc), {mds_sql('m', 'll', 'g', 'label')}
    select label, {S.r6('x', 'x')}, {S.r6('y', 'y')}, {S.r6('stress', 'stress')} from mxy join mst using (g)"""
)
def mds_classical(spark: SparkSession, sf: str) -> DataFrame:
    made = linalg.classical_mds(P.label_centroids(spark, sf).withColumn("g", F.lit(0)), ["g"], "label")
    return D.rounded(made.drop("g"), "x", "y", "stress")


#: Velocities of the path, numbered, and the peaks among them; a plateau counts once, at its middle.
PEAKS_SQL = f"""{D.PATH_SQL}, ve as (select (a.year + b.year) / 2 as spot, list_distance(a.vec, b.vec) / abs(b.year - a.year) as v, row_number() over (order by a.year) as i from num a join num b on b.i = a.i + 1),
pk as (select * from (select *, lag(v) over (order by i) as before, lead(v) over (order by i) as after from ve) where before < v and after < v),
lo as (select p.i, (select coalesce(max(q.i), 0) from ve q where q.i < p.i and q.v > p.v) as l, (select coalesce(min(q.i), 1000000000) from ve q where q.i > p.i and q.v > p.v) as r from pk p),
pr as (select p.*, p.v - greatest((select min(q.v) from ve q where q.i > l and q.i <= p.i), (select min(q.v) from ve q where q.i < r and q.i >= p.i)) as prominence from pk p join lo using (i)),
pks as (select spot, v as peak, prominence from pr where prominence >= 0.8 * (select stddev_pop(v) from ve))"""


@register(f"with {PEAKS_SQL} select 'all' as series, spot as at, {S.r6('peak', 'peak')}, {S.r6('prominence', 'prominence')} from pks")
def velocity_peaks(spark: SparkSession, sf: str) -> DataFrame:
    made = linalg.peaks(geometry.velocity(D.trajectory(spark, sf), ["series"], "year"), ["series"], "at", "velocity")
    return D.rounded(made, "peak", "prominence")
