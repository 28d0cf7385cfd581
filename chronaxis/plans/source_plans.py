"""Queries through sources, sinks and providers, and on scalar functions, order and union.

Those that write do so below the folder that the cluster shares, and read what they wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronaxis.functions import stats
from chronaxis.operators import probes, series
from chronaxis.plans import domain as D
from chronaxis.plans import literals
from chronaxis.plans import sql as S
from chronaxis.plans import vector_plans as P
from chronaxis.plans.registry import Registry
from chronaxis.plans.series_plans import PATTERNS, stars_sql
from chronaxis.sources import tables

register = Registry()
r6 = S.r6

#: Interval files as they may come: other columns, other orders, quotes, values that are no numbers, no start, a lost column.
FILES = {
    "ages": "name,start_year,end_year\nstone,-700,-600\nbronze,-500,x\n?,?,5\n",
    "reigns": 'end_year,note,name,start_year\n1100,"a, b","One, the first",1066\n,,Two,1100\n1154,,Three,1135.5\n',
    "broken": "name,begin,end_year\nlost,1,2\n",
    "skipped": "name,start_year,end_year\nz,1,2\n",
}
#: Two sheets as landed: lines before the data, columns by position, rows without a year or value.
WAGES = "Table 47,,,\n,,,\nyear,a,b,cpi\n1209.0,1,2,2.5\n1210,1,2,\nnote,1,2,4\n1211,1,2,3.5\n1212,1,2,4\n"
EARNINGS = "Table 48,\nyear,real\n1211,10\n1212.0,11.5\n1213,12\n,9\n"


def _files(spark: SparkSession) -> str:
    path = tables.scratch(spark, "intervals")
    for name, text in FILES.items():
        tables.put_text(spark, f"{path}/{name}.csv", text)
    return path


@register("select * from (values ('ages', 'stone', -700::double, -600::double), ('ages', 'bronze', -500, null), ('reigns', 'One, the first', 1066, 1100), ('reigns', 'Two', 1100, null), ('reigns', 'Three', 1135.5, 1154)) t(series, name, start_year, end_year)")
def interval_files(spark: SparkSession, sf: str) -> DataFrame:
    """A directory of interval files: a skip-list, each file by its own header, bad files left aside."""
    return tables.interval_directory(spark, _files(spark), skip=["skipped"])[0]


@register("select 'broken' as series, 'missing columns: start_year' as message")
def interval_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The files that could not be read, and why."""
    return tables.interval_directory(spark, _files(spark), skip=["skipped"])[1]


@register("select * from (values ('ages', 'bronze', -500::double, null::double), ('reigns', 'One, the first', 1066, 1100), ('reigns', 'Three', 1135.5, 1154)) t(series, name, start_year, end_year)")
def interval_stride(spark: SparkSession, sf: str) -> DataFrame:
    """Interval files from a first year on, thinned to two rows a series, evenly."""
    rows = tables.interval_directory(spark, _files(spark), skip=["skipped"], start_from=-600)[0]
    return series.stride_sample(rows, ["series"], ["start_year", "name"], 2)


@register("select * from (values (1209::int, 2.5::double, null::double), (1211, 3.5, 10), (1212, 4, 11.5), (1213, null, 12)) t(year, cpi, real_earn)")
def macro_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Two yearly sheets, columns by position, merged by a full outer join."""
    path = tables.scratch(spark, "sheets")
    tables.put_text(spark, f"{path}/wages.csv", WAGES)
    tables.put_text(spark, f"{path}/earnings.csv", EARNINGS)
    return tables.merged_macro(tables.yearly_series(spark, f"{path}/wages.csv", 0, 3, skip=3), tables.yearly_series(spark, f"{path}/earnings.csv", skip=2))


@register(f"with {P.AXIS_SQL} select 'm' as model, 'time' as axis, layer, unnest(range(16))::int as pos, {r6('unnest(axis)', 'v')} from ax where layer = 2")
def directions_table(spark: SparkSession, sf: str) -> DataFrame:
    """Directions saved as a table by model and layer; one layer loaded again."""
    path = tables.scratch(spark, "directions")
    axes = D.difference_axis(D.cells(spark, sf), ["layer"])
    tables.save_directions(axes.select(F.lit("m").alias("model"), F.lit("time").alias("axis"), "layer", F.col("axis").alias("vec")), path)
    return D.rounded(tables.load_directions(spark, path, "m", 2).select("model", "axis", "layer", F.posexplode("vec").alias("pos", "v")), "v")


_TEXTS_SQL = "t as (select 'year ' || y as text, (row_number() over (order by y) - 1)::int as ord from (select unnest(generate_series(1200, 1900, 25)) as y))"


def _answered(spark: SparkSession) -> str:
    """Requests written for distinct texts, and answers made from what was written; every tenth failed."""
    requests, answers = tables.scratch(spark, "requests"), tables.scratch(spark, "answers")
    years = literals.year_grid(spark, 1200, 1900, 25)
    texts = probes.distinct_texts(years.select(F.concat(F.lit("year "), F.col("year").cast("string")).alias("text"), ((F.col("year") - 1200) / 25).cast("int").alias("ord")), "ord")
    tables.write_requests(texts, requests, "small")
    asked = spark.read.schema("custom_id string, body struct<input:string>").json(requests)
    n = F.split("custom_id", "-")[1].cast("int")
    vec = F.array(F.length("body.input").cast("float"), n.cast("float"))
    response = F.struct(F.struct(F.array(F.struct(vec.alias("embedding"))).alias("data")).alias("body"))
    asked.select("custom_id", F.when(n % 10 == 9, "late").alias("error"), F.when(n % 10 != 9, response).alias("response")).write.json(answers)
    return answers


@register(f"with {_TEXTS_SQL} select ord, 0 as pos, length(text)::double as v from t where ord % 10 <> 9 union all select ord, 1, ord from t where ord % 10 <> 9")
def batch_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors of a batch job, by the number in each answer's id."""
    return tables.read_responses(spark, _answered(spark))[0].select("ord", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


@register(f"with {_TEXTS_SQL} select 'req-' || ord as custom_id, 'late' as error from t where ord % 10 = 9")
def batch_errors(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_responses(spark, _answered(spark))[1].select("custom_id", "error")


@register("select 'b-1' as batch_id, 2::bigint as n_texts, unnest(range(2))::int as pos, unnest(['one', 'zwei é']) as text")
def batch_state(spark: SparkSession, sf: str) -> DataFrame:
    """The state of a batch job, saved and loaded as one JSON document."""
    path = tables.scratch(spark, "state")
    tables.save_state(spark, path, batch_id="b-1", n_texts=2, texts=["one", "zwei é"])
    state = tables.load_state(spark, path)
    return spark.createDataFrame([(state["batch_id"], state["n_texts"], state["texts"])], "batch_id string, n_texts long, texts array<string>").select("batch_id", "n_texts", F.posexplode("texts").alias("pos", "text"))


@register(f"with {D.MONTHS_SQL}, t as (select year, avg(value) as value from ord group by year) select year, {r6('value', 'value')}, {r6('cpi', 'cpi')} from t full join price using (year)")
def csv_sink(spark: SparkSession, sf: str) -> DataFrame:
    """A result frame written as one CSV file, nulls as empty fields, and read back."""
    path = tables.scratch(spark, "result")
    own = D.values(spark, sf).groupBy("year").agg(F.avg("value").alias("value"))
    tables.write_csv(series.outer_merge(own, D.prices(spark, sf).select("year", "cpi")), path)
    return D.rounded(spark.read.schema("year int, value double, cpi double").csv(path, header=True), "value", "cpi")


def _measure(texts: list[str]) -> list[list[list[float]]]:
    """A stand-in for a model: two layers of two values."""
    return [[[float(len(t)), 1.0], [float(t.count("1")), float(len(t.split()))]] for t in texts]


@register(
    "with t as (select distinct replace(p, '{y}', y::varchar) as text from (select unnest(generate_series(1200, 1900, 25)) as y), (select unnest(["
    + ", ".join(f"'{p}'" for p in PATTERNS)
    + "]) as p)), v as (select text, l.layer, case when l.layer = 0 then [length(text)::double, 1] else [length(text) - length(replace(text, '1', '')), len(string_split(text, ' '))] end as vec from t, (select unnest(range(2))::int as layer) l) select text, layer, unnest(range(2))::int as pos, unnest(vec) as v from v"
)
def provider_embed(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct texts embedded by a function over batches, one row a layer and position."""
    texts = probes.expand(literals.year_grid(spark, 1200, 1900, 25), literals.templates(spark, *PATTERNS), y="year")
    made = probes.by_layer(probes.embed_with(texts.unionByName(texts).select("text"), _measure))
    return made.select("text", "layer", F.posexplode("vec").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


@register("select event_type, try_cast(json_extract_string(props, '$.k') as int) as k, regexp_replace(replace(event_type, '_', ' '), '^(.)', upper(substr(event_type, 1, 1))) as title, substr(event_type, 1, 4) as short, string_split('ev-' || event_type, '-')[2] as part, regexp_extract('/a/b/' || event_type || '.csv', '([^/]*)\\.[^.]*$', 1) as stem, trim('  ' || event_type || ' ') as trimmed, count(*) as n from events group by all")
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Scalar functions on text: replace, prefix, split, path stem, trim, JSON field, cast."""
    e, c = tables.driver_table(spark, sf, "events"), F.col("event_type")
    made = e.groupBy("event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k")).agg(F.count("*").alias("n"))
    title = F.concat(F.upper(F.substring(c, 1, 1)), F.substring(F.replace(c, F.lit("_"), F.lit(" ")), 2, 1000))
    path = F.concat(F.lit("/a/b/"), c, F.lit(".csv"))
    return made.select("event_type", "k", title.alias("title"), F.substring(c, 1, 4).alias("short"), F.split(F.concat(F.lit("ev-"), c), "-")[1].alias("part"), F.regexp_extract(path, r"([^/]*)\.[^.]*$", 1).alias("stem"), F.trim(F.concat(F.lit("  "), c, F.lit(" "))).alias("trimmed"), "n")


_CAPS = {"1-URGENT": 24, "2-HIGH": 36}


@register(f"with {D.MONTHS_SQL}, m as (select *, case entity {' '.join(f"when '{k}' then {v}" for k, v in _CAPS.items())} else 12 end as cap from ord), rn as (select *, row_number() over (partition by entity order by year) - 1 as i, count(*) over (partition by entity) as k from m) select entity, cap, year from rn where k <= cap or i in (select round_even(s * (k - 1) / (cap - 1.0), 0) from (select unnest(range(36)) as s) where s < cap)")
def capped_series(spark: SparkSession, sf: str) -> DataFrame:
    """Rows a series by a map of caps with a default, evenly thinned."""
    caps = F.create_map(*[F.lit(x) for pair in _CAPS.items() for x in pair])
    rows = D.values(spark, sf).withColumn("cap", F.coalesce(F.try_element_at(caps, F.col("entity")), F.lit(12)))
    w = Window.partitionBy("entity")
    at = rows.withColumns({"i": F.row_number().over(w.orderBy("year")) - 1, "k": F.count("*").over(w)})
    picks = F.transform(F.sequence(F.lit(0), F.col("cap") - 1), lambda s: F.rint(s * (F.col("k") - 1) / (F.col("cap") - 1)).cast("int"))
    return at.filter((F.col("k") <= F.col("cap")) | F.array_contains(picks, F.col("i"))).select("entity", "cap", "year")


@register(f"with {D.MONTHS_SQL}, m as (select entity, avg(value) as mean from ord group by entity) select (row_number() over (order by round(mean, 6) desc, entity) - 1)::int as place, entity, {r6('mean', 'mean')} from m")
def ranked_series(spark: SparkSession, sf: str) -> DataFrame:
    """Series in descending order of their mean, the name deciding ties; the order is a column."""
    made = D.values(spark, sf).groupBy("entity").agg(F.avg("value").alias("mean"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round("mean", 6)), "entity")) - 1
    return D.rounded(made.select(place.alias("place"), "entity", "mean"), "mean").orderBy("place")


@register(
    f"""with {D.REAL_SQL}, d as (select entity, value - lag(value) over w as dv, (case when purch_power > 0 then ln(purch_power) end) - lag(case when purch_power > 0 then ln(purch_power) end) over w as dr from al window w as (partition by entity order by year)),
    a as (select 'level' as kind, *, {S.p_sql('rho', 'n')} as p from {D.spearman_sql('al', 'entity', 'value', 'purch_power')} union all select 'change', *, {S.p_sql('rho', 'n')} from {D.spearman_sql('d', 'entity', 'dv', 'dr')})
    select kind, entity, {r6('rho', 'rho')}, n, {stars_sql('n', 'p')} as sig, printf('%-8s %-16s rho=%.3f %s', kind, entity, round(rho, 9), {stars_sql('n', 'p')}) as line from a"""
)
def correlation_report(spark: SparkSession, sf: str) -> DataFrame:
    """Level and change results in one frame, with the line that a console would show."""
    rows = D.aligned(spark, sf)
    level = stats.spearman(rows, ["entity"], "value", "purch_power").withColumn("kind", F.lit("level"))
    change = stats.spearman(stats.first_differences(rows, ["entity"], "year", "value", "purch_power"), ["entity"], "d_value", "d_real").withColumn("kind", F.lit("change"))
    made = level.unionByName(change).withColumn("sig", stats.stars(stats.p_value("rho", "n"), F.col("n")))
    line = F.format_string("%-8s %-16s rho=%.3f %s", "kind", "entity", F.round("rho", 9), "sig")
    return D.rounded(made.select("kind", "entity", "rho", "n", "sig", line.alias("line")), "rho")


@register(
    f"""with {D.MONTHS_SQL}, c as (select entity, year - avg(year) over w as u, value - avg(value) over w as v from ord window w as (partition by entity)),
    s as (select entity, count(*) as n, sum(u * u) as uu, sum(u * v) as uv, sum(v * v) as vv, sum(u ** 3) as u3, sum(u ** 4) as u4, sum(u * u * v) as u2v from c group by entity)
    select entity, case when (u2v - u3 * uv / uu) ** 2 / ((u4 - uu * uu / n - u3 * u3 / uu) * vv) > 0.05 then 'curved' else 'straight' end as shape from s"""
)
def shape_label(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a parabola explains clearly more than a line."""
    made = stats.poly_r2(D.values(spark, sf), ["entity"], "year", "value")
    return made.select("entity", F.when(F.col("r2_quadratic") > F.col("r2_linear") + 0.05, "curved").otherwise("straight").alias("shape"))
