"""Literal sources: denominations, grids, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pre-decimal coins in pence.
PENCE = {"farthing": 0.25, "halfpenny": 0.5, "penny": 1, "threepence": 3, "groat": 4, "sixpence": 6, "shilling": 12, "florin": 24, "half-crown": 30, "crown": 60, "half-sovereign": 120, "sovereign": 240, "guinea": 252}


def denominations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in PENCE.items()], "name string, pence double")


def year_grid(spark: SparkSession, start: int, stop: int, step: int) -> DataFrame:
    """Both ends included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(stop), F.lit(step))).alias("year"))


def templates(spark: SparkSession, *patterns: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(patterns)), "template_id int, pattern string")


#: A small interval series with an overlap, a gap and an open end.
PERIODS = (("a", "one", 0.0, 10.0), ("a", "two", 8.0, 20.0), ("a", "three", 30.0, 45.0), ("a", "four", 40.0, None), ("b", "x", 5.0, 25.0), ("b", "y", 26.0, 50.0))


def periods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PERIODS), "series string, name string, start_year double, end_year double")


#: Eras of the velocity figure: first year, last year, name.  Fixed values.
ERAS = ((-600, 0, "Antiquity"), (0, 500, "Late Antiquity"), (500, 1000, "Early Medieval"), (1000, 1500, "High/Late Medieval"), (1500, 1800, "Early Modern"), (1800, 1925, "Modern"))


def eras(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ERAS), "first int, last int, era string")
