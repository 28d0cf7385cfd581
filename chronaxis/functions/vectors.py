"""Vector expressions on ARRAY columns; arithmetic is in DOUBLE throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null for unequal lengths."""
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def unit(v: Column) -> Column:
    size = norm(v) + TINY
    return F.transform(v, lambda x: x.cast("double") / size)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + TINY)


def distance(a: Column, b: Column) -> Column:
    return norm(minus(a, b))


def angle(cos: Column) -> Column:
    """Degrees between two lines, 0 to 90."""
    return F.degrees(F.acos(F.least(F.abs(cos), F.lit(1.0))))


def layer(v: Column, k: Column | int, width: int) -> Column:
    """The k-th stretch of ``width`` values."""
    return F.slice(v, F.lit(k) * width + 1, width)


def diagnostics(v: Column, limit: float = 200.0) -> tuple[Column, Column]:
    """(all values finite, norm over the limit)."""
    odd = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return ~odd, norm(v) > limit


def spread(df: DataFrame, vec: str, pos: str = "pos", value: str = "v") -> DataFrame:
    """Long form: one row a position instead of the array."""
    return df.select(*[c for c in df.columns if c != vec], F.posexplode(vec).alias(pos, value)).withColumn(value, F.col(value).cast("double"))


def gather(df: DataFrame, keys: list[str], value: str, name: str = "vec", pos: str = "pos") -> DataFrame:
    """Back to one array a key, in order of position."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("x"))))
    return df.groupBy(*keys).agg(F.transform(packed, lambda s: s["x"]).alias(name))


def centroids(df: DataFrame, keys: list[str], vec: str, name: str = "vec") -> DataFrame:
    """Mean vector of each key.  Positions are summed map-side; only key x position rows are shuffled."""
    means = spread(df.select(*keys, vec), vec).groupBy(*keys, "pos").agg(F.avg("v").alias("m"))
    return gather(means, keys, "m", name)


def scaled(long: DataFrame, groups: list[str], value: str = "v") -> DataFrame:
    """Standard scores by group and position: population deviation, zero counts as one."""
    stats = long.groupBy(*groups, "pos").agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return long.join(stats, [*groups, "pos"]).withColumn(value, (F.col(value) - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)).drop("__m", "__s")
