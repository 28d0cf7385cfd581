"""The domain's frames as drawn from the driver tables, and the same as SQL.

A "year" is a month index (January 1995 is 0) for series from ``orders`` and
``lineitem``, and ``1200 + 75 * label`` for embeddings.  Sixteen values of an
embedding are one pseudo-layer; ``vec_id % 8`` stands for the template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronaxis.functions import vectors as V
from chronaxis.operators import series
from chronaxis.sources.tables import driver_table

LAYERS, WIDTH, TEMPLATES = 4, 16, 8
EARLY, LATE = 2, 7  # labels up to, and from


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six decimals, no negative zero: equal for any order of summation.  Nine come first, so that noise can't tip a half."""
    return df.withColumns({c: F.round(F.round(c, 9), 6) + 0.0 for c in columns})


def month(c: str) -> Column:
    return (F.year(c) - 1995) * 12 + F.month(c) - 1


def values(spark: SparkSession, sf: str) -> DataFrame:
    """``entity, year, value``: monthly mean order price by priority."""
    return driver_table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("entity"), month("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("value"))


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """``year, cpi, earn``: monthly mean line price and quantity."""
    return driver_table(spark, sf, "lineitem").groupBy(month("l_shipdate").alias("year")).agg(F.avg("l_extendedprice").alias("cpi"), F.avg("l_quantity").alias("earn"))


def real(spark: SparkSession, sf: str) -> DataFrame:
    """``year, cpi, earn, purch_power`` in centred windows."""
    return series.anchored(series.band_mean(values(spark, sf), prices(spark, sf), ["cpi", "earn"]))


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Values with the real series of their month; the months are few, so they are broadcast."""
    return values(spark, sf).join(F.broadcast(real(spark, sf)), "year", "left")


def points(spark: SparkSession, sf: str) -> DataFrame:
    """``vec_id, label, tmpl, mid, vec``."""
    e = driver_table(spark, sf, "embeddings")
    return e.select("vec_id", "label", (F.col("vec_id") % TEMPLATES).cast("int").alias("tmpl"), (F.col("label") * 75 + 1200).alias("mid"), F.col("embedding").alias("vec"))


def layers(df: DataFrame) -> DataFrame:
    """One row a pseudo-layer."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(LAYERS - 1)), lambda k: F.struct(k.cast("int").alias("layer"), V.layer(F.col("vec"), k, WIDTH).alias("vec")))
    return df.select(*[c for c in df.columns if c != "vec"], F.explode(cut).alias("__l")).select("*", "__l.layer", "__l.vec").drop("__l")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """``layer, tmpl, label, mid, vec``: the centroid of each period, template and layer."""
    return V.centroids(layers(points(spark, sf)), ["layer", "tmpl", "label", "mid"], "vec")


def trajectory(spark: SparkSession, sf: str) -> DataFrame:
    """``series, year, vec``: centroids of five vectors each, 25 years apart."""
    e = driver_table(spark, sf, "embeddings")
    return V.centroids(e.select(F.lit("all").alias("series"), (F.floor(F.col("vec_id") / 5) * 25 + 1200).cast("double").alias("year"), F.col("embedding").alias("vec")), ["series", "year"], "vec")


def difference_axis(df: DataFrame, keys: list[str]) -> DataFrame:
    """``axis``: unit vector from the early to the late centroid, for each key."""
    long = V.spread(df.select(*keys, "label", "vec"), "vec")
    means = long.groupBy(*keys, "pos").agg((F.avg(F.when(F.col("label") >= LATE, F.col("v"))) - F.avg(F.when(F.col("label") <= EARLY, F.col("v")))).alias("d"))
    return V.gather(means, keys, "d", "__d").select(*keys, V.unit(F.col("__d")).alias("axis"))


MONTHS_SQL = """
ord as (select o_orderpriority as entity, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::int as year, avg(o_totalprice) as value from orders group by all),
price as (select ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::int as year, avg(l_extendedprice) as cpi, avg(l_quantity) as earn from lineitem group by all)"""
REAL_SQL = f"""{MONTHS_SQL},
band as (select p.year, avg(q.cpi) as cpi, avg(q.earn) as earn from (select distinct year from ord) p left join price q on q.year between p.year - 7 and p.year + 7 group by p.year),
anch as (select *, case when cpi > 0 then (select arg_min(cpi, year) from band where cpi is not null) / cpi end as purch_power from band),
al as (select o.*, a.cpi, a.earn, a.purch_power from ord o left join anch a using (year))"""
POINTS_SQL = """
pts as (select vec_id, label, (vec_id % 8)::int as tmpl, label * 75 + 1200 as mid, embedding::double[] as vec from embeddings)"""
LONG_SQL = f"""{POINTS_SQL},
lay as (select vec_id, label, tmpl, mid, l.layer, vec[l.layer * 16 + 1 : l.layer * 16 + 16] as vec from pts, (select unnest(range(4))::int as layer) l),
long as (select vec_id, label, tmpl, mid, layer, unnest(range(16))::int as pos, unnest(vec) as v from lay),
cell as (select layer, tmpl, label, mid, pos, avg(v) as v from long group by all),
cvec as (select layer, tmpl, label, mid, list(v order by pos) as vec from cell group by all)"""
PATH_SQL = """
path as (select year, list(v order by pos) as vec from (select year, pos, avg(v) as v from (select ((vec_id // 5) * 25 + 1200)::double as year, unnest(range(64)) as pos, unnest(embedding::double[]) as v from embeddings) group by all) group by all),
num as (select *, row_number() over (order by year) as i, count(*) over () as n from path)"""


def axis_sql(source: str, keys: str) -> str:
    """Of a long table: ``keys, axis``."""
    return f"""(select {keys}, list(d / size order by pos) as axis from (select *, sqrt(sum(d * d) over (partition by {keys})) + 1e-12 as size from (
      select {keys}, pos, avg(v) filter (label >= {LATE}) - avg(v) filter (label <= {EARLY}) as d from {source} group by all)) group by {keys})"""


def spearman_sql(source: str, groups: str, x: str, y: str, least: int = 3) -> str:
    """``groups, rho, n`` of a table."""
    rank = "rank() over (partition by {g} order by {c}) + (count(*) over (partition by {g}, {c}) - 1) / 2.0"
    return f"""(select {groups}, case when count(*) >= {least} then covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) end as rho, count(*) as n from (
      select {groups}, {rank.format(g=groups, c=x)} as rx, {rank.format(g=groups, c=y)} as ry from {source} where {x} is not null and {y} is not null) group by {groups})"""
