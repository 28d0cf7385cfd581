"""Yearly and interval-coded series: windows, anchors, ordinals, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_mean(probe: DataFrame, data: DataFrame, values: list[str], half: int = 7, year: str = "year") -> DataFrame:
    """Mean of each value over data years within ``half`` of each probe year; null where there is none.

    The band becomes an equi-join: each data row is sent to the years it serves.
    """
    sent = data.select(F.explode(F.sequence(F.col(year) - half, F.col(year) + half)).alias(year), *values)
    means = sent.groupBy(year).agg(*[F.avg(v).alias(v) for v in values])
    return probe.select(year).distinct().join(means, year, "left")


def anchored(means: DataFrame, cpi: str = "cpi", year: str = "year") -> DataFrame:
    """``purch_power``: the first year's mean (else the first there is) over each mean, where that is positive."""
    anchor = means.filter(F.col(cpi).isNotNull()).agg(F.min_by(cpi, year).alias("__anchor"))
    return means.crossJoin(F.broadcast(anchor)).withColumn("purch_power", F.when(F.col(cpi) > 0, F.col("__anchor") / F.col(cpi))).drop("__anchor")


def outer_merge(a: DataFrame, b: DataFrame, key: str = "year") -> DataFrame:
    return a.join(b, key, "full_outer")


def moving_average(df: DataFrame, groups: list[str], order: str, value: str, name: str, width: int = 5) -> DataFrame:
    """Centred mean over ``width`` rows; beyond the ends the first and last value are repeated."""
    half = width // 2
    w = Window.partitionBy(*groups)
    i, n = F.row_number().over(w.orderBy(order)), F.count("*").over(w)
    first, last = F.first(value).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(value).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inside = F.sum(value).over(w.orderBy(order).rowsBetween(-half, half))
    before, after = F.greatest(F.lit(half) - i + 1, F.lit(0)), F.greatest(i + half - n, F.lit(0))
    return df.withColumn(name, (inside + before * first + after * last) / width)


def indexed(intervals: DataFrame, series: str = "series") -> DataFrame:
    """``idx``: position by start, then name, within the series; rows without a start are dropped."""
    w = Window.partitionBy(series).orderBy("start_year", "name")
    return intervals.filter("start_year is not null").withColumn("idx", F.row_number().over(w) - 1)


def ordinals(intervals: DataFrame, grid: DataFrame, natural: bool = True) -> DataFrame:
    """``series, year, ordinal``: mean index of the periods that hold the year; in a gap, between its neighbours.

    With ``natural``, null outside first start to last known end (2025 if none is known).
    """
    own = indexed(intervals)
    met = own.crossJoin(F.broadcast(grid.select("year")))
    holds = (F.col("start_year") <= F.col("year")) & (F.col("year") <= F.coalesce("end_year", F.lit(9999.0)))
    before, after = F.col("start_year") <= F.col("year"), F.col("start_year") > F.col("year")
    made = met.groupBy("series", "year").agg(
        F.avg(F.when(holds, F.col("idx"))).alias("inside"),
        F.max(F.when(before, F.struct("start_year", "idx"))).alias("b"), F.min(F.when(after, F.struct("start_year", "idx"))).alias("a"),
        F.min("start_year").alias("lo"), F.coalesce(F.max("end_year"), F.lit(2025.0)).alias("hi"),
    )
    between = F.col("b.idx") + (F.col("a.idx") - F.col("b.idx")) * (F.col("year") - F.col("b.start_year")) / (F.col("a.start_year") - F.col("b.start_year") + 1e-9)
    value = F.coalesce("inside", between, F.col("b.idx").cast("double"), F.col("a.idx").cast("double"))
    return made.select("series", "year", F.when(F.lit(not natural) | F.col("year").between(F.col("lo"), F.col("hi")), value).alias("ordinal"))


def overlap(ordinal: DataFrame) -> DataFrame:
    """How many series have a value in each year."""
    return ordinal.groupBy("year").agg(F.count("ordinal").alias("n_series"))


def mid_year(start: Column, end: Column) -> Column:
    return (start + F.coalesce(end, start)) / 2.0


def stride_sample(df: DataFrame, groups: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each group, evenly spread (half-even rounding); smaller groups stay whole."""
    w = Window.partitionBy(*groups)
    rows = df.withColumns({"__i": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.rint(i * (F.col("__n") - 1) / (most - 1)).cast("int"))
    return rows.filter((F.col("__n") <= most) | F.array_contains(picks, F.col("__i"))).drop("__i", "__n")


def every_nth(df: DataFrame, order: str, groups: list[str], n: int = 6) -> DataFrame:
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*groups).orderBy(order)) - 1).filter(F.col("__i") % n == 0).drop("__i")
