"""The tidy frames behind figures: one query a figure or panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronaxis.functions import stats
from chronaxis.functions import vectors as V
from chronaxis.operators import geometry, linalg, series
from chronaxis.plans import domain as D
from chronaxis.plans import linear_plans as L
from chronaxis.plans import literals
from chronaxis.plans import metric_plans as M
from chronaxis.plans import sql as S
from chronaxis.plans import vector_plans as P
from chronaxis.plans.linear_plans import DOT, on_axis
from chronaxis.plans.registry import Registry
from chronaxis.plans.series_plans import ORDINAL_SQL, stars_sql
from chronaxis.sources.tables import small

register = Registry()
r6 = S.r6

# Axes and coins.

_VALUE_SQL = f"{L.MINNORM_SQL}, vp as (select layer, label, target, {DOT('vec', 'axis')} as p from lv join nax using (layer) join (select layer, label, target from ly) using (layer, label))"


@register(
    f"""with recursive {_VALUE_SQL}, u as (select *, target - avg(target) over w as u, avg(p) over w as m from vp window w as (partition by layer)), s as (select layer, sum(u * u) as uu, sum(u ** 3) as u3, count(*) as n, sum(u * p) as up from u group by layer),
    q as (select u.*, uu, up, u * u - uu / n - u3 / uu * u as q from u join s using (layer)), b as (select layer, sum(q * p) / sum(q * q) as b from q group by layer)
    select layer, label, {r6('target', 'target')}, {r6('p', 'p')}, {r6('m + up / uu * u', 'fit_1')}, {r6('m + up / uu * u + b * q', 'fit_2')} from q join b using (layer)"""
)
def axes_value_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Coins on the value axis against their log value, with the line and the parabola through them."""
    made, axis = L.value_axis(spark, sf)
    fitted = stats.poly_fit(on_axis(made, axis, ["layer"]).drop("vec"), ["layer"], "target", "p")
    return D.rounded(fitted.select("layer", "label", "target", "p", "fit_1", "fit_2"), "target", "p", "fit_1", "fit_2")


@register(
    f"""with {P.PROJ_SQL}, y as (select layer, mid, avg(p) as p from proj group by all), rn as (select *, row_number() over (partition by layer order by mid) as i, count(*) over (partition by layer) as k from y),
    r as (select layer, rho from {D.spearman_sql('y', 'layer', 'p', 'mid')})
    select c.layer, c.mid, {r6('any_value(c.p)', 'p')}, {r6('avg(r.p)', 'smooth')}, c.mid % 100 = 0 as century, {r6('any_value(x.rho)', 'rho')} from rn c, (select unnest(range(-2, 3)) as s) s join rn r on r.layer = c.layer and r.i = least(greatest(c.i + s.s, 1), c.k) join r x on x.layer = c.layer group by all"""
)
def axes_year_smooth(spark: SparkSession, sf: str) -> DataFrame:
    """Years on the time axis with a moving average that repeats its edges; whole centuries are marked."""
    years = P.projected(spark, sf).groupBy("layer", "mid").agg(F.avg("p").alias("p"))
    smooth = series.moving_average(years, ["layer"], "mid", "p", "smooth").withColumn("century", F.col("mid") % 100 == 0)
    return D.rounded(smooth.join(stats.spearman(years, ["layer"], "p", "mid").drop("n"), "layer"), "p", "smooth", "rho")


@register(
    f"""with recursive {_VALUE_SQL}, r as (select *, row_number() over (partition by layer order by round(p, 9), label) - 1 as place from vp)
    select layer, place::int as place, label, {r6('p', 'p')}, case when place % 2 = 0 then 'above' else 'below' end as side, 'label ' || label || chr(10) || '(' || (label + 1) || 'd)' as caption from r"""
)
def denomination_axis(spark: SparkSession, sf: str) -> DataFrame:
    """Coins in the order of their projections, captions above and below in turn."""
    made, axis = L.value_axis(spark, sf)
    place = F.row_number().over(Window.partitionBy("layer").orderBy(F.round("p", 9), "label")) - 1
    placed = on_axis(made, axis, ["layer"]).withColumn("place", place)
    caption = F.format_string("label %d\n(%dd)", F.col("label"), F.col("label") + 1)
    return D.rounded(placed.select("layer", "place", "label", "p", F.when(F.col("place") % 2 == 0, "above").otherwise("below").alias("side"), caption.alias("caption")), "p")


# Series.

_DIFF_SQL = f"""{D.REAL_SQL}, d as (select entity, (year + lag(year) over w) / 2 as at_year, value - lag(value) over w as dv, (case when purch_power > 0 then ln(purch_power) end) - lag(case when purch_power > 0 then ln(purch_power) end) over w as dr from al window w as (partition by entity order by year))"""


def _z(x: str) -> str:
    return f"case when stddev_pop({x}) over w > 1e-12 then ({x} - avg({x}) over w) / stddev_pop({x}) over w when {x} is not null then 0 end"


@register(
    f"""with {_DIFF_SQL}, f as (select * from d where at_year is not null), r as (select entity, rho, {S.p_sql('rho', 'n')} as p, n from {D.spearman_sql('f', 'entity', 'dv', 'dr')})
    select entity, at_year, {r6(_z('dv'), 'z_value')}, {r6(_z('dr'), 'z_real')}, {r6('rho', 'rho')}, {stars_sql('n', 'p')} as sig from f join r using (entity) window w as (partition by entity)"""
)
def change_frame(spark: SparkSession, sf: str) -> DataFrame:
    """First differences of both series in standard scores at the mid-points, with their rank correlation."""
    w = Window.partitionBy("entity").orderBy("year")
    diffs = stats.first_differences(D.aligned(spark, sf), ["entity"], "year", "value", "purch_power").withColumn("at_year", (F.col("year") + F.lag("year").over(w)) / 2).filter("at_year is not null")
    rho = stats.spearman(diffs, ["entity"], "d_value", "d_real").withColumn("p", stats.p_value("rho", "n"))
    made = diffs.withColumns({"z_value": stats.zscore("d_value", ["entity"]), "z_real": stats.zscore("d_real", ["entity"])}).join(rho, "entity")
    return D.rounded(made.select("entity", "at_year", "z_value", "z_real", "rho", stats.stars(F.col("p"), F.col("n")).alias("sig")), "z_value", "z_real", "rho")


@register(f"with {D.MONTHS_SQL} select year, 'cpi' as series, {r6('cpi', 'value')} from price where cpi is not null and year between 0 and 80 union all select year, 'earn', {r6('earn', 'value')} from price where earn is not null and year between 0 and 80")
def main_macro(spark: SparkSession, sf: str) -> DataFrame:
    """Both real series within the figure's years, those without a value left out."""
    prices = D.prices(spark, sf).filter(F.col("year").between(0, 80))
    long = prices.select("year", F.explode(F.create_map(F.lit("cpi"), F.col("cpi"), F.lit("earn"), F.col("earn"))).alias("series", "value"))
    return D.rounded(long.dropna(), "value")


@register(f"with {D.REAL_SQL}, c as (select * from al where value is not null and purch_power is not null), r as {D.spearman_sql('c', 'entity', 'value', 'purch_power')} select entity, year, {r6('value', 'value')}, {r6('purch_power', 'purch_power')}, {r6('rho', 'rho')} from c join r using (entity)")
def main_scatter(spark: SparkSession, sf: str) -> DataFrame:
    rows = stats.complete(D.aligned(spark, sf), "value", "purch_power")
    made = rows.join(stats.spearman(rows, ["entity"], "value", "purch_power").drop("n"), "entity")
    return D.rounded(made.select("entity", "year", "value", "purch_power", "rho"), "value", "purch_power", "rho")


def _unit(x: str) -> str:
    return f"case when max({x}) over w - min({x}) over w >= 1e-12 then ({x} - min({x}) over w) / (max({x}) over w - min({x}) over w) when {x} is not null then 0 end"


@register(
    f"""with {D.REAL_SQL}, a as (select entity, year, value from al union all select distinct 'purch_power', year, purch_power from al where purch_power is not null)
    select entity, year, {r6(_unit('value'), 'scaled')} from a window w as (partition by entity)"""
)
def main_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Every value series and the real one, each scaled to 0..1."""
    rows = D.aligned(spark, sf)
    power = rows.filter("purch_power is not null").select(F.lit("purch_power").alias("entity"), "year", F.col("purch_power").alias("value")).distinct()
    both = rows.select("entity", "year", "value").unionByName(power)
    return D.rounded(both.select("entity", "year", stats.minmax("value", ["entity"]).alias("scaled")), "scaled")


@register(
    f"""with {D.REAL_SQL}, r as (select entity, rho, {S.p_sql('rho', 'n')} as p, n from {D.spearman_sql('al', 'entity', 'value', 'earn')})
    select entity, year, {r6(_unit('value'), 'proj')}, {r6(_unit('earn'), 'real_value')}, {r6('rho', 'rho')}, n, {stars_sql('n', 'p')} as sig from al join r using (entity) window w as (partition by entity)"""
)
def normalised_vs_real(spark: SparkSession, sf: str) -> DataFrame:
    """Each series and its real counterpart, scaled to 0..1 whatever is missing, with correlation and stars."""
    rows = D.aligned(spark, sf)
    rho = stats.spearman(rows, ["entity"], "value", "earn").withColumn("p", stats.p_value("rho", "n"))
    made = rows.withColumns({"proj": stats.minmax("value", ["entity"]), "real_value": stats.minmax("earn", ["entity"])}).join(rho, "entity")
    return D.rounded(made.select("entity", "year", "proj", "real_value", "rho", "n", stats.stars(F.col("p"), F.col("n")).alias("sig")), "proj", "real_value", "rho")


# The battery.

_COVER_SQL = f"{ORDINAL_SQL}, na as (select series, min(start_year) as lo, coalesce(max(end_year), 2025) as hi from i group by series), cv as (select series, min(year) as first_year, max(year) as last_year, count(*) as n from o where ordinal is not null group by series)"


@register(f"with {_COVER_SQL} select series, lo, hi, first_year, last_year, n, (row_number() over (order by lo, series) - 1)::int as row from na left join cv using (series)")
def coverage_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Each series' own range and the grid years that it covers, in the order of the bars."""
    own = literals.periods(spark).groupBy("series").agg(F.min("start_year").alias("lo"), F.coalesce(F.max("end_year"), F.lit(2025.0)).alias("hi"))
    held = series.ordinals(literals.periods(spark), literals.year_grid(spark, -5, 70, 5)).filter("ordinal is not null")
    covered = held.groupBy("series").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("n"))
    return own.join(covered, "series", "left").withColumn("row", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("lo", "series")) - 1)


@register(f"with {ORDINAL_SQL}, c as (select year, count(ordinal) as k from o group by year) select year as from_year, to_year, k as n_series from (select *, lead(year) over (order by year) as to_year from c) where to_year is not null and k > 1")
def coverage_shading(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches between grid years that more than one series covers."""
    counts = series.overlap(series.ordinals(literals.periods(spark), literals.year_grid(spark, -5, 70, 5)))
    ahead = counts.withColumn("to_year", F.lead("year").over(Window.partitionBy(F.lit(0)).orderBy("year")))
    return ahead.filter("to_year is not null and n_series > 1").select(F.col("year").alias("from_year"), "to_year", "n_series")


@register(f"with {P.SWEEP_SQL}, t as (select *, {S.p_sql('rho', 'n')} as p from sweep) select tmpl, layer, {r6('rho', 'rho')}, {r6('p', 'p')}, n, {M.STARS(p='p')} as star, printf('%.2f%s (n=%d)', round(rho, 9), {M.STARS(p='p')}, n) as cell from t")
def layer_sweep_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The cells of the sweep's heat map: correlation, p, stars and the text."""
    made = P.sweep(spark, sf).withColumn("p", stats.p_value("rho", "n")).withColumn("star", stats.stars_battery(F.col("p")))
    return D.rounded(made.withColumn("cell", F.format_string("%.2f%s (n=%d)", F.round("rho", 9), F.col("star"), F.col("n"))), "rho", "p")


@register(
    f"""with recursive {M.BATTERY_SQL}, mb as (select layer, row_number() over (order by round(avg(abs(rho)), 9) desc, layer) as r from bt group by layer), ov as (select year, count(ordinal) as n_series from o group by year)
    select layer, px.step, {r6('p1', 'p1')}, coalesce(n_series, 0) as n_series from px join mb using (layer) left join ov on ov.year = px.step where r = 1"""
)
def battery_projection(spark: SparkSession, sf: str) -> DataFrame:
    """The year path on the first component of the layer with the greatest mean correlation, with the number of series there."""
    scores, own, made = M.battery(spark, sf)
    best = made.groupBy("layer").agg(F.avg(F.abs("rho")).alias("m")).agg(F.min(F.struct((-F.round("m", 9)).alias("r"), "layer"))["layer"].alias("layer"))
    placed = scores.join(F.broadcast(best), "layer").join(series.overlap(own).withColumnRenamed("year", "step"), "step", "left")
    return D.rounded(placed.select("layer", "step", "p1", F.coalesce("n_series", F.lit(0)).alias("n_series")), "p1")


# The year manifold.

_SHAPE_SQL = f"""{D.LONG_SQL}, {M.PATH_AXIS_SQL}, {S.axes_sql('p', 'pl', 'layer', 'year', 3)}, {S.weighed_sql('p', 'layer')},
pt as (select 'year' as kind, layer, year::double as at_year, -1 as tmpl, vec from pv union all select 'period', layer, mid::double, tmpl, vec from cvec)"""


def _shape(spark: SparkSession, sf: str, k: int, periods: bool) -> DataFrame:
    path = M.year_path(spark, sf).select(F.lit("year").alias("kind"), "layer", F.col("year").alias("at_year"), F.lit(-1).alias("tmpl"), "vec")
    points = path.unionByName(D.cells(spark, sf).select(F.lit("period").alias("kind"), "layer", F.col("mid").cast("double").alias("at_year"), "tmpl", "vec")) if periods else path
    return D.rounded(linalg.scores(points, small(linalg.components(path, ["layer"], k=k)), ["layer"], ["kind", "at_year", "tmpl"]), "score", "share")


@register(f"with recursive {_SHAPE_SQL}, s as ({S.scores_sql('p', 'pt', 'layer', 'kind, at_year, tmpl')}) select layer, kind, at_year, tmpl, component, {r6('score', 'score')}, {r6('share', 'share')} from s")
def year_manifold(spark: SparkSession, sf: str) -> DataFrame:
    """Three components of the year path; periods are projected into the same space."""
    return _shape(spark, sf, 3, True)


@register(f"with recursive {_SHAPE_SQL}, s as ({S.scores_sql('p', 'pv', 'layer', 'year')}) select layer, year as at_year, component, {r6('score', 'score')}, {r6('share', 'share')} from s where component < 2")
def layer_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Two components of the year path, layer by layer."""
    return _shape(spark, sf, 2, False).drop("kind", "tmpl")


_ERA_ROWS = ", ".join(f"({a}, {b}, '{n}')" for a, b, n in literals.ERAS)
_DYNAMICS_SQL = f"""{L.PEAKS_SQL}, st as (select a.year, {S.minus_sql('a.vec', 'z.vec')} as u, {S.minus_sql('b.vec', 'a.vec')} as w from num a join num z on z.i = a.i - 1 join num b on b.i = a.i + 1),
s as (select c.year, r.i, unnest(range(64)) as pos, unnest(r.vec) as v from num c join num r on r.i between c.i - 4 and c.i + 4 where c.i > 4 and c.i <= c.n - 4), z as (select year, i, list(d order by pos) as x from (select year, i, pos, v - avg(v) over (partition by year, pos) as d from s) group by all),
gr as (select a.year, a.i = b.i as own, {DOT('a.x', 'b.x')} as g from z a join z b on a.year = b.year),
dy as (select 'velocity' as metric, spot as at_year, v as value, spot in (select spot from pks) as peak from ve
  union all select 'curvature', year, degrees(acos(greatest(least({DOT('u', 'w')} / (sqrt({DOT('u', 'u')}) * sqrt({DOT('w', 'w')}) + 1e-12), 1), -1))), false from st
  union all select 'dimension', year, case when sum(g) filter (own) <= 1e-12 then 1 else (sum(g) filter (own)) ** 2 / sum(g * g) end, false from gr group by year)"""


@register(f"with {_DYNAMICS_SQL}, er(first, last, era) as (values {_ERA_ROWS}) select metric, at_year, {r6('value', 'value')}, peak, era from dy left join er on at_year >= first and at_year < last")
def path_dynamics(spark: SparkSession, sf: str) -> DataFrame:
    """Velocity with its peaks, curvature and local dimension along the path, with the era of each."""
    path = D.trajectory(spark, sf)
    speed = geometry.velocity(path, ["series"], "year")
    peak = linalg.peaks(speed, ["series"], "at", "velocity").select("at", F.lit(True).alias("peak"))
    frames = [
        speed.join(small(peak), "at", "left").select(F.lit("velocity").alias("metric"), F.col("at").alias("at_year"), F.col("velocity").alias("value"), F.coalesce("peak", F.lit(False)).alias("peak")),
        geometry.curvature(path, ["series"], "year").select(F.lit("curvature"), "year", "curvature", F.lit(False)),
        geometry.local_dimension(path, ["series"], "year").select(F.lit("dimension"), "year", "dimension", F.lit(False)),
    ]
    made = reduce(DataFrame.union, frames)
    eras = F.broadcast(literals.eras(spark))
    return D.rounded(made.join(eras, (F.col("at_year") >= F.col("first")) & (F.col("at_year") < F.col("last")), "left").select("metric", "at_year", "value", "peak", "era"), "value")


@register(f"with recursive {D.LONG_SQL}, {L.mds_sql('m', 'cell', 'layer', 'tmpl, label')} select layer, tmpl, label, {r6('x', 'x')}, {r6('y', 'y')}, {r6('stress', 'stress')} from mxy join mst using (layer)")
def joint_mds(spark: SparkSession, sf: str) -> DataFrame:
    """All period centroids of all series in two dimensions, by layer, with the stress."""
    cells = D.cells(spark, sf).withColumn("id", F.col("tmpl") * 100 + F.col("label"))
    made = linalg.classical_mds(cells, ["layer"], "id")
    return D.rounded(made.select("layer", F.floor(F.col("id") / 100).cast("int").alias("tmpl"), (F.col("id") % 100).alias("label"), "x", "y", "stress"), "x", "y", "stress")


@register(
    f"""with recursive {D.LONG_SQL}, {M.PATH_AXIS_SQL}, {S.axes_sql('p', 'pl', 'layer', 'year', 1)}, {S.risen_sql('p', 'pv', 'layer', 'year')},
    pj as (select layer, tmpl, mid, {DOT(S.minus_sql('vec', 'mean'), 'axis')} as proj from cvec join pup using (layer) join pmean using (layer)),
    tr as (select layer, tmpl, count(*) as n, regr_slope(proj, mid) as slope, regr_intercept(proj, mid) as intercept, covar_pop(proj, mid) / nullif(stddev_pop(proj) * stddev_pop(mid), 0) as r from pj group by all)
    select layer, tmpl, mid, {r6('proj', 'proj')}, case when n >= 4 then round(slope, 9) + 0.0 end as slope, case when n >= 4 then {r6('intercept', 'x').removesuffix(' as x')} end as intercept, case when n >= 4 then {r6('r', 'x').removesuffix(' as x')} end as r, case when n >= 4 then {r6(S.p_sql('r', 'n'), 'x').removesuffix(' as x')} end as p from pj join tr using (layer, tmpl)"""
)
def pc1_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Periods of each series on the years' first component, with each series' trend."""
    path = M.year_path(spark, sf)
    mean = V.centroids(path, ["layer"], "vec", "mean")
    placed = D.cells(spark, sf).join(small(mean), "layer").withColumn("vec", V.minus(F.col("vec"), F.col("mean")))
    points = on_axis(placed, linalg.first_component(path, ["layer"], "year"), ["layer"], "proj").select("layer", "tmpl", "mid", "proj")
    trend = stats.ols(points, ["layer", "tmpl"], "mid", "proj", least=4).withColumn("p", F.when(F.col("n") >= 4, stats.p_value("r", "n")))
    made = points.join(trend.drop("n"), ["layer", "tmpl"]).withColumn("slope", F.round("slope", 9) + 0.0)
    return D.rounded(made, "proj", "intercept", "r", "p")


@register(
    f"""with {D.LONG_SQL}, s as (select layer, tmpl, mid, vec, lag(vec) over w as before, lag(mid) over w as t, count(*) over (partition by layer, tmpl) as n from cvec window w as (partition by layer, tmpl order by mid)),
    v as (select layer, tmpl, (mid + t) / 2 as at_year, case when abs(mid - t) >= 2 then list_distance(vec, before) / abs(mid - t) end as velocity from s where t is not null and n >= 3)
    select layer, tmpl, at_year, round(velocity, 9) + 0.0 as velocity from (select *, count(velocity) over (partition by layer, tmpl) as k from v) where k >= 2"""
)
def series_velocity(spark: SparkSession, sf: str) -> DataFrame:
    """Velocity between the periods of each series; series of under three periods or two finite steps go."""
    keys = ["layer", "tmpl"]
    made = geometry.velocity(D.cells(spark, sf), keys, "mid").withColumn("k", F.count("velocity").over(Window.partitionBy(*keys))).withColumn("steps", F.count("*").over(Window.partitionBy(*keys)))
    return made.filter("k >= 2 and steps >= 2").select(*keys, F.col("at").alias("at_year"), (F.round("velocity", 9) + 0.0).alias("velocity"))


# Sequences.

_LINES = ("spearman_rho", "bw_ratio", "centroid_tau", "knn_purity")
_HEAT = (*_LINES, "cross_cosine", "cross_rho")


def _absolute(name: str) -> str:
    return f"abs({name})" if name == "centroid_tau" else name


def _long(spark: SparkSession, sf: str, names: tuple[str, ...]) -> DataFrame:
    """``metric, seq, layer, value``; tau by its size."""
    made = M.metrics(spark, sf).withColumn("centroid_tau", F.abs("centroid_tau"))
    return made.select("seq", "layer", F.expr(f"stack({len(names)}, {', '.join(f"'{n}', {n}" for n in names)}) as (metric, value)"))


@register(f"with recursive {M.METRIC_SQL} " + " union all ".join(f"select '{n}' as metric, seq, layer, {r6(_absolute(n), 'value')} from mt" for n in _LINES))
def metric_lines(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(_long(spark, sf, _LINES), "value")


_CROSS = ("cross_cosine", "cross_rho")


@register(f"with recursive {M.METRIC_SQL} " + " union all ".join(f"select '{n}' as metric, seq, layer, {r6(n, 'value')} from mt" for n in _CROSS))
def cross_axis_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine and correlation with the year axis, by sequence and layer."""
    return D.rounded(_long(spark, sf, _CROSS), "value")


@register(f"with recursive {M.METRIC_SQL} select 'template_robust' as figure, seq, layer, {r6('tmpl_robustness', 'value')} from mt")
def template_robust_lines(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(M.metrics(spark, sf).select(F.lit("template_robust").alias("figure"), "seq", "layer", F.col("tmpl_robustness").alias("value")), "value")


_PARTS = ("spearman_rho", "centroid_tau", "knn_purity", "cross_cosine", "cross_rho")


@register(
    f"with recursive {M.METRIC_SQL}, t as (select seq, {', '.join(f'max(coalesce(abs({n}), 0)) as {n}' for n in _PARTS)}, max(coalesce(abs(bw_ratio), 0)) as b from mt group by seq) select seq, {', '.join(r6(n, n) for n in _PARTS)}, {r6('b / (max(b) over () + 1e-9)', 'bw_ratio')} from t"
)
def composite_bars(spark: SparkSession, sf: str) -> DataFrame:
    """The greatest size of each metric by sequence; the ratio against the greatest of all."""
    made = M.metrics(spark, sf).groupBy("seq").agg(*[F.max(F.coalesce(F.abs(n), F.lit(0.0))).alias(n) for n in (*_PARTS, "bw_ratio")])
    top = F.max("bw_ratio").over(Window.partitionBy(F.lit(0)))  # a row a sequence
    return D.rounded(made.withColumn("bw_ratio", F.col("bw_ratio") / (top + 1e-9)), *_PARTS, "bw_ratio")


@register(
    f"with recursive {M.METRIC_SQL} " + " union all ".join(f"select '{n}' as metric, seq, " + ", ".join(r6(f"max({_absolute(n)}) filter (layer = {k})", f"layer_{k}") for k in range(D.LAYERS)) + " from mt group by seq" for n in _HEAT)
)
def metric_heatmaps(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each metric and sequence, a column for each layer."""
    made = _long(spark, sf, _HEAT).groupBy("metric", "seq").pivot("layer", list(range(D.LAYERS))).agg(F.first("value"))
    names = [f"layer_{k}" for k in range(D.LAYERS)]
    return D.rounded(made.select("metric", "seq", *[F.col(str(k)).alias(n) for k, n in enumerate(names)]), *names)


#: The layer of the figure that shows one layer for all sequences.
FIXED_LAYER = 1
_PCA_SQL = f"""{M.SEQ_SQL}, {M.BEST_SQL}, {S.weighed_sql("q", "seq, layer")}, pick as (select 'best' as choice, seq, layer, bw from bl union all select 'fixed', seq, layer, bw from bwr where layer = {FIXED_LAYER}),
ps as ({S.scores_sql("q", "sv", "seq, layer", "tmpl, label")}), pw as (select choice, seq, layer, bw, tmpl, label, max(score) filter (component = 0) as x, max(score) filter (component = 1) as y, max(share) filter (component = 0) as share_x, max(share) filter (component = 1) as share_y from ps join pick using (seq, layer) group by all)"""


def _scatter(spark: SparkSession, sf: str) -> DataFrame:
    """``choice, seq, layer, bw, tmpl, label, x, y, share_x, share_y`` at the best layers and at the fixed one."""
    scaled = M.sequence_cells(spark, sf)[1]
    bw = geometry.bw_ratio(V.spread(scaled, "vec"), M.SEQ, "label")
    pick = M.best_layers(spark, sf).withColumn("choice", F.lit("best")).unionByName(bw.filter(F.col("layer") == FIXED_LAYER).withColumn("choice", F.lit("fixed")))
    made = linalg.scores(scaled, small(linalg.components(scaled, M.SEQ, k=2)), M.SEQ, ["tmpl", "label"])
    at = lambda c, k: F.max(F.when(F.col("component") == k, F.col(c)))
    wide = made.groupBy(*M.SEQ, "tmpl", "label").agg(at("score", 0).alias("x"), at("score", 1).alias("y"), at("share", 0).alias("share_x"), at("share", 1).alias("share_y"))
    return wide.join(small(pick), M.SEQ)


@register(f"with recursive {_PCA_SQL} select choice, seq, layer, {r6('bw', 'bw')}, tmpl, label, {r6('x', 'x')}, {r6('y', 'y')}, {r6('share_x', 'share_x')}, {r6('share_y', 'share_y')} from pw")
def pca_scatter(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(_scatter(spark, sf), "bw", "x", "y", "share_x", "share_y")


@register(f"with recursive {_PCA_SQL} select choice, seq, layer, label, {r6('avg(x)', 'x')}, {r6('avg(y)', 'y')} from pw group by choice, seq, layer, label")
def pca_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """The stars of the scatter: each period's centroid."""
    return D.rounded(_scatter(spark, sf).groupBy("choice", "seq", "layer", "label").agg(F.avg("x").alias("x"), F.avg("y").alias("y")), "x", "y")


@register(
    f"""with recursive {M.SEQ_SQL}, {M.BEST_SQL}, nr as {M.near_sql('sv', 'seq, layer', '{0}.label * 100 + {0}.tmpl')}, k as (select seq, layer, bw, label, near, count(*) as k from nr join bl using (seq, layer) group by all), s as (select *, k / sum(k) over (partition by seq, label) as share from k)
    select seq, layer, {r6('bw', 'bw')}, label, near, {r6('share', 'share')}, case when share > 0.02 then printf('%.2f', round(share, 9)) end as cell from s"""
)
def confusion_best(spark: SparkSession, sf: str) -> DataFrame:
    """Which period the nearest point of another period belongs to, at each sequence's best layer."""
    best = M.best_layers(spark, sf)
    points = M.sequence_cells(spark, sf)[1].join(small(best), M.SEQ)
    made = geometry.confusion(geometry.nearest(points, M.SEQ, "label", "id"), M.SEQ, "label").join(small(best), M.SEQ)
    return D.rounded(made.withColumn("cell", F.when(F.col("share") > 0.02, F.format_string("%.2f", F.round("share", 9)))), "bw", "share")
