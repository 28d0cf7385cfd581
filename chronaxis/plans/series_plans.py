"""Queries on series: windows, anchors, rank correlation, trends, ordinals, expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronaxis.functions import stats
from chronaxis.operators import probes, series
from chronaxis.plans import domain as D
from chronaxis.plans import literals
from chronaxis.plans import sql as S
from chronaxis.plans.registry import Registry
from chronaxis.sources.tables import driver_table
from chronaxis.streaming.windows import windowed_mean

register = Registry()
R = "round(round({0}, 9), 6) + 0.0 as {0}".format
_PERIODS = ", ".join(f"('{s}', '{n}', {a}::double, {'null' if b is None else b}::double)" for s, n, a, b in literals.PERIODS)
ORDINAL_SQL = f"""
p(series, name, start_year, end_year) as (values {_PERIODS}),
i as (select *, row_number() over (partition by series order by start_year, name) - 1 as idx from p),
g as (select unnest(generate_series(-5, 70, 5))::int as year),
m as (select series, year, avg(idx) filter (start_year <= year and year <= coalesce(end_year, 9999)) as inside,
  max(start_year) filter (start_year <= year) as bs, arg_max(idx, start_year) filter (start_year <= year) as b,
  min(start_year) filter (start_year > year) as az, arg_min(idx, start_year) filter (start_year > year) as a,
  min(start_year) as lo, coalesce(max(end_year), 2025) as hi from i, g group by all),
o as (select series, year, case when year between lo and hi then coalesce(inside, b + (a - b) * (year - bs) / (az - bs + 1e-9), b, a) end as ordinal from m)"""
ROLL_SQL = f"""{D.REAL_SQL},
rn as (select *, row_number() over (partition by entity order by year) as i, count(*) over (partition by entity) as k from al),
sent as (select c.entity, c.year, r.value, r.purch_power from rn c join rn r on r.entity = c.entity and r.i between c.i - 7 and c.i + 7 where c.i > 7 and c.i <= c.k - 7),
roll as (select entity, year, round(rho, 9) as rho, n from {D.spearman_sql("sent", "entity, year", "value", "purch_power")})"""


@register(f"with {D.REAL_SQL} select entity, {R('rho')}, n from {D.spearman_sql('al', 'entity', 'value', 'purch_power')}")
def spearman_levels(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(stats.spearman(D.aligned(spark, sf), ["entity"], "value", "purch_power"), "rho")


@register(
    f"""with {D.REAL_SQL}, d as (select entity, value - lag(value) over w as dv, (case when purch_power > 0 then ln(purch_power) end) - lag(case when purch_power > 0 then ln(purch_power) end) over w as dr
    from al window w as (partition by entity order by year)) select entity, {R('rho')}, n from {D.spearman_sql('d', 'entity', 'dv', 'dr')}"""
)
def spearman_diff(spark: SparkSession, sf: str) -> DataFrame:
    diffs = stats.first_differences(D.aligned(spark, sf), ["entity"], "year", "value", "purch_power")
    return D.rounded(stats.spearman(diffs, ["entity"], "d_value", "d_real"), "rho")


def _rolled(spark: SparkSession, sf: str) -> DataFrame:
    rolled = stats.rolling_spearman(D.aligned(spark, sf), ["entity"], "year", "value", "purch_power")
    return rolled.withColumn("rho", F.round("rho", 9))


@register(f"with {ROLL_SQL} select entity, year, {R('rho')}, n from roll")
def spearman_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(_rolled(spark, sf), "rho")


@register(
    f"""with {ROLL_SQL}, o as (select *, row_number() over (partition by entity order by rho desc, year) as p, row_number() over (partition by entity order by rho, year) as t from roll where rho is not null)
    select entity, max(round(round(rho, 9), 6) + 0.0) filter (p = 1) as peak, max(year) filter (p = 1) as peak_at, max(round(round(rho, 9), 6) + 0.0) filter (t = 1) as trough, max(year) filter (t = 1) as trough_at from o group by entity"""
)
def rolling_extrema(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(stats.extremes(_rolled(spark, sf), ["entity"], "year"), "peak", "trough")


_STARS = "case when {n} < 3 then 'n/a' when {p} < 0.01 then '**' when {p} < 0.05 then '*' else 'ns' end".format


def stars_sql(n: str, p: str) -> str:
    return _STARS(n=n, p=p)


_BATTERY = "case when {p} < 0.001 then '***' when {p} < 0.01 then '**' when {p} < 0.05 then '*' else '' end".format


@register(
    f"""with {D.REAL_SQL}, a as {D.spearman_sql('al', 'entity', 'value', 'purch_power')}, b as (select entity, rho as rho_earn, n as n_earn from {D.spearman_sql('al', 'entity', 'value', 'earn')}),
    t as (select *, {S.p_sql('rho', 'n')} as p, {S.p_sql('rho_earn', 'n_earn')} as p_earn from a join b using (entity))
    select entity, {R('rho')}, n, {R('rho_earn')}, n_earn, {R('p')}, {R('p_earn')}, {_STARS(n='n', p='p')} as sig, {_BATTERY(p='p')} as sig_battery from t"""
)
def correlation_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlation with both real series, its p-value and both kinds of stars."""
    made = stats.spearman(D.aligned(spark, sf), ["entity"], "value", "purch_power").join(stats.spearman(D.aligned(spark, sf), ["entity"], "value", "earn", rho="rho_earn", n="n_earn"), "entity")
    made = made.withColumns({"p": stats.p_value("rho", "n"), "p_earn": stats.p_value("rho_earn", "n_earn")})
    made = made.withColumns({"sig": stats.stars(F.col("p"), F.col("n")), "sig_battery": stats.stars_battery(F.col("p"))})
    return D.rounded(made, "rho", "rho_earn", "p", "p_earn")


@register(f"with {D.REAL_SQL} select year, {R('cpi')}, {R('earn')} from band")
def window_mean_band(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(series.band_mean(D.values(spark, sf), D.prices(spark, sf), ["cpi", "earn"]), "cpi", "earn")


@register(f"with {D.REAL_SQL} select year, {R('purch_power')} from anch")
def anchor_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(D.real(spark, sf), "purch_power").select("year", "purch_power")


@register(f"with {D.MONTHS_SQL}, t as (select year, avg(value) as value from ord group by year) select year, {R('value')}, {R('cpi')} from t full join price using (year)")
def outer_merge_series(spark: SparkSession, sf: str) -> DataFrame:
    own = D.values(spark, sf).groupBy("year").agg(F.avg("value").alias("value"))
    return D.rounded(series.outer_merge(own, D.prices(spark, sf).select("year", "cpi")), "value", "cpi")


@register(
    f"""with {D.MONTHS_SQL}, rn as (select *, row_number() over (partition by entity order by year) as i, count(*) over (partition by entity) as k from ord)
    select c.entity, c.year, round(round(avg(r.value), 9), 6) + 0.0 as smooth from rn c, (select unnest(range(-2, 3)) as s) s join rn r on r.entity = c.entity and r.i = least(greatest(c.i + s.s, 1), c.k) group by all"""
)
def moving_avg_edge(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(series.moving_average(D.values(spark, sf), ["entity"], "year", "value", "smooth"), "smooth").select("entity", "year", "smooth")


@register(f"with {D.MONTHS_SQL} select entity, year, round(round(case when sd > 1e-12 then (value - m) / sd else 0 end, 9), 6) + 0.0 as z from (select *, avg(value) over w as m, stddev_pop(value) over w as sd from ord window w as (partition by entity))")
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(D.values(spark, sf).withColumn("z", stats.zscore("value", ["entity"])), "z").select("entity", "year", "z")


@register(f"with {D.MONTHS_SQL} select entity, year, round(round(case when hi - lo >= 1e-12 then (value - lo) / (hi - lo) else 0 end, 9), 6) + 0.0 as scaled from (select *, min(value) over w as lo, max(value) over w as hi from ord window w as (partition by entity))")
def minmax(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(D.values(spark, sf).withColumn("scaled", stats.minmax("value", ["entity"])), "scaled").select("entity", "year", "scaled")


@register(f"with {D.MONTHS_SQL} select entity, round(round(regr_slope(value, year), 9), 6) + 0.0 as slope, round(round(regr_intercept(value, year), 9), 6) + 0.0 as intercept, round(round(covar_pop(value, year) / nullif(stddev_pop(value) * stddev_pop(year), 0), 9), 6) + 0.0 as r, count(*) as n from ord group by entity")
def ols_trend(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(stats.ols(D.values(spark, sf), ["entity"], "year", "value"), "slope", "intercept", "r")


@register(
    f"""with {D.MONTHS_SQL}, c as (select entity, year - avg(year) over w as u, value - avg(value) over w as v from ord window w as (partition by entity)),
    s as (select entity, count(*) as n, sum(u * u) as uu, sum(u * v) as uv, sum(v * v) as vv, sum(u ** 3) as u3, sum(u ** 4) as u4, sum(u * u * v) as u2v from c group by entity)
    select entity, round(round(uv * uv / (uu * vv), 9), 6) + 0.0 as r2_linear, round(round(uv * uv / (uu * vv) + (u2v - u3 * uv / uu) ** 2 / ((u4 - uu * uu / n - u3 * u3 / uu) * vv), 9), 6) + 0.0 as r2_quadratic from s"""
)
def poly_r2(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(stats.poly_r2(D.values(spark, sf), ["entity"], "year", "value"), "r2_linear", "r2_quadratic")


@register(f"with {ORDINAL_SQL} select series, year, {R('ordinal')} from o")
def ordinal_position(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(series.ordinals(literals.periods(spark), literals.year_grid(spark, -5, 70, 5)), "ordinal")


@register(f"with {ORDINAL_SQL} select year, count(ordinal) as n_series from o group by year")
def overlap_density(spark: SparkSession, sf: str) -> DataFrame:
    return series.overlap(series.ordinals(literals.periods(spark), literals.year_grid(spark, -5, 70, 5)))


@register(f"with {ORDINAL_SQL} select series, min(start_year) as lo, coalesce(max(end_year), 2025) as hi, count(*) as n from i group by series")
def natural_range(spark: SparkSession, sf: str) -> DataFrame:
    return literals.periods(spark).groupBy("series").agg(F.min("start_year").alias("lo"), F.coalesce(F.max("end_year"), F.lit(2025.0)).alias("hi"), F.count("*").alias("n"))


@register(f"with p(series, name, start_year, end_year) as (values {_PERIODS}) select series, name, (start_year + coalesce(end_year, start_year)) / 2 as mid from p")
def period_mid(spark: SparkSession, sf: str) -> DataFrame:
    return literals.periods(spark).select("series", "name", series.mid_year(F.col("start_year"), F.col("end_year")).alias("mid"))


@register(
    f"""with {D.MONTHS_SQL}, rn as (select *, row_number() over (partition by entity order by year) - 1 as i, count(*) over (partition by entity) as k from ord)
    select entity, year, {R('value')} from rn where k <= 20 or i in (select round_even(s * (k - 1) / 19.0, 0) from (select unnest(range(20)) as s))"""
)
def stride_sample(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(series.stride_sample(D.values(spark, sf), ["entity"], ["year"], 20), "value")


@register(f"with {D.MONTHS_SQL} select entity, year, {R('value')} from (select *, row_number() over (partition by entity order by year) - 1 as i from ord) where i % 6 = 0")
def every_sixth(spark: SparkSession, sf: str) -> DataFrame:
    return D.rounded(series.every_nth(D.values(spark, sf), "year", ["entity"]), "value")


#: Probe patterns of the year grid.
PATTERNS = ("In the year {y}.", "It was {y}.", "The year is {y}.", "A coin of {y}.")


@register("select year, t.template_id, replace(t.pattern, '{y}', year::varchar) as text from (select unnest(generate_series(1200, 1900, 25))::int as year), (values " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(PATTERNS)) + ") t(template_id, pattern)")
def template_expand(spark: SparkSession, sf: str) -> DataFrame:
    return probes.expand(literals.year_grid(spark, 1200, 1900, 25), literals.templates(spark, *PATTERNS), y="year").select("year", "template_id", "text")


@register("select year, (year + unnest(range(-3, 4)))::int as near_year from (select unnest(generate_series(1250, 1920, 10))::int as year)")
def year_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return probes.year_neighbourhood(literals.year_grid(spark, 1250, 1920, 10))


@register(
    "select text, min(ord) as ord from (select 'year ' || near as text, year * 10 as ord from (select year, year + unnest(range(-3, 4)) as near from (select unnest(generate_series(1250, 1920, 5)) as year))) group by text"
)
def distinct_texts(spark: SparkSession, sf: str) -> DataFrame:
    near = probes.year_neighbourhood(literals.year_grid(spark, 1250, 1920, 5))
    return probes.distinct_texts(near.select(F.concat(F.lit("year "), "near_year").alias("text"), (F.col("year") * 10).cast("long").alias("ord")), "ord")


@register("select p.name, d.label, round(round(ln(p.pence), 9), 6) + 0.0 as log_pence from (values " + ", ".join(f"('{k}', {v}::double)" for k, v in literals.PENCE.items()) + ") p(name, pence), (select distinct label from embeddings) d")
def literal_cross(spark: SparkSession, sf: str) -> DataFrame:
    labels = driver_table(spark, sf, "embeddings").select("label").distinct()
    made = labels.crossJoin(F.broadcast(literals.denominations(spark)))
    return D.rounded(made.select("name", "label", F.ln("pence").alias("log_pence")), "log_pence")


@register("select event_type, count(k) as n, round(round(avg(k), 9), 6) + 0.0 as mean_k from (select event_type, try_cast(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) as int) as k from events) group by event_type")
def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    e = driver_table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k"))
    return D.rounded(e.groupBy("event_type").agg(F.count("k").alias("n"), F.avg("k").alias("mean_k")), "mean_k")


@register("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, round(round(avg(value), 9), 6) + 0.0 as mean_value, count(value) as n from events group by all")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming operator over a finished table."""
    made = windowed_mean(driver_table(spark, sf, "events"))
    return D.rounded(made.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "mean_value", "n"), "mean_value")


@register(f"with {D.MONTHS_SQL} select entity, min(year) as first_year, max(year) as last_year, arg_max(year, value) as best_year, count(distinct year) as n_years from ord group by entity")
def series_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage, distinct count and the row of the greatest value; the first wins a tie."""
    v = D.values(spark, sf)
    return v.groupBy("entity").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min(F.struct(-F.col("value"), "year"))["year"].alias("best_year"), F.countDistinct("year").alias("n_years"))


@register(f"with {D.MONTHS_SQL} select year, count(value) filter (entity not in ('5-LOW')) as n_values from ord group by year")
def row_density(spark: SparkSession, sf: str) -> DataFrame:
    """Values per year, a skip-list applied."""
    v = D.values(spark, sf)
    return v.groupBy("year").agg(F.count(F.when(~F.col("entity").isin("5-LOW"), F.col("value"))).alias("n_values"))


@register(f"with {D.MONTHS_SQL} select * from (select year, {R('value')}, entity from ord where year between 10 and 40 union all select year, {R('cpi')}, 'cpi' from price where year between 10 and 40)")
def appended_series(spark: SparkSession, sf: str) -> DataFrame:
    """A derived series appended to the set, within a range of years."""
    both = D.values(spark, sf).select("year", "value", "entity").unionByName(D.prices(spark, sf).select("year", F.col("cpi").alias("value"), F.lit("cpi").alias("entity")))
    return D.rounded(both.filter(F.col("year").between(10, 40)), "value")


