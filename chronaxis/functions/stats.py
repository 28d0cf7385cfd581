"""Rank correlation, trends and tests as grouped DataFrame operators."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; null where a side is constant."""
    a, b = F.col(x), F.col(y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def average_rank(value: str, groups: list[str]) -> Column:
    """Rank within the group; ties share their mean rank."""
    return F.rank().over(Window.partitionBy(*groups).orderBy(value)) + (F.count("*").over(Window.partitionBy(*groups, value)) - 1) / 2.0


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where all the columns hold a number."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def spearman(df: DataFrame, groups: list[str], x: str, y: str, least: int = 3, rho: str = "rho", n: str = "n") -> DataFrame:
    """Pearson of average ranks over pairwise complete rows; null below ``least`` rows."""
    ranked = complete(df, x, y).withColumns({"__x": average_rank(x, groups), "__y": average_rank(y, groups)})
    made = ranked.groupBy(*groups).agg(safe_corr("__x", "__y").alias(rho), F.count("*").alias(n))
    return made.withColumn(rho, F.when(F.col(n) >= least, F.col(rho)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_test_p(r: float, n: float) -> float | None:
    """Two-sided p of a correlation by Student's t with n - 2 degrees of freedom."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    v = n - 2
    return beta_inc(v / 2, 0.5, v / (v + r * r * v / (1 - r * r)))


@F.pandas_udf(DoubleType())
def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([t_test_p(None if pd.isna(a) else float(a), None if pd.isna(b) else float(b)) for a, b in zip(r, n, strict=True)], dtype="float64")


def stars(p: Column, n: Column | None = None) -> Column:
    """``**`` under .01, ``*`` under .05, else ``ns``; ``n/a`` under three rows."""
    made = F.when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
    return made if n is None else F.when(n < 3, "n/a").otherwise(made)


def stars_battery(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def zscore(x: str, groups: list[str]) -> Column:
    w = Window.partitionBy(*groups)
    sd = F.stddev_pop(x).over(w)
    return F.when(sd > 1e-12, (F.col(x) - F.avg(x).over(w)) / sd).when(F.col(x).isNotNull(), 0.0)


def minmax(x: str, groups: list[str]) -> Column:
    w = Window.partitionBy(*groups)
    low, span = F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w)
    return F.when(span >= 1e-12, (F.col(x) - low) / span).when(F.col(x).isNotNull(), 0.0)


def first_differences(df: DataFrame, groups: list[str], order: str, value: str, real: str, log: bool = True) -> DataFrame:
    """``d_value`` and ``d_real`` to the row before; logs of ``real`` where it is positive."""
    w = Window.partitionBy(*groups).orderBy(order)
    source = F.when(F.col(real) > 0, F.ln(real)) if log else F.col(real)
    return df.withColumn("__r", source).withColumns({"d_value": F.col(value) - F.lag(value).over(w), "d_real": F.col("__r") - F.lag("__r").over(w)}).drop("__r")


def rolling_spearman(df: DataFrame, groups: list[str], order: str, x: str, y: str, width: int = 15, least: int = 3) -> DataFrame:
    """Rank correlation in full centred windows of rows; ``order`` names the centre.

    Each row is sent to the ``width`` windows that hold it by explode, an equi-join
    with the centres, so the cost is rows times width.
    """
    half = width // 2
    w = Window.partitionBy(*groups)
    rows = df.withColumns({"__i": F.row_number().over(w.orderBy(order)), "__n": F.count("*").over(w)})
    sent = rows.select(
        *groups, F.col(x).alias("__vx"), F.col(y).alias("__vy"), "__n", F.explode(F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda k: F.col("__i") + k)).alias("__c")
    ).filter(F.col("__c").between(half + 1, F.col("__n") - half))
    made = spearman(sent, [*groups, "__c"], "__vx", "__vy", least)
    centres = rows.select(*groups, order, F.col("__i").alias("__c")).filter(F.col("__c").between(half + 1, F.col("__n") - half))
    return centres.join(made, [*groups, "__c"], "left").drop("__c")


def extremes(rolled: DataFrame, groups: list[str], order: str) -> DataFrame:
    """Peak and trough of ``rho`` and where; ties go to the first."""
    live = rolled.filter("rho is not null")
    peak, trough = F.min(F.struct((-F.col("rho")).alias("r"), F.col(order).alias("at"))), F.min(F.struct(F.col("rho").alias("r"), F.col(order).alias("at")))
    return live.groupBy(*groups).agg(peak.alias("p"), trough.alias("t")).select(*groups, (-F.col("p.r")).alias("peak"), F.col("p.at").alias("peak_at"), F.col("t.r").alias("trough"), F.col("t.at").alias("trough_at"))


def ols(df: DataFrame, groups: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Slope, intercept, r and n of the least-squares line."""
    made = complete(df, x, y).groupBy(*groups).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), safe_corr(x, y).alias("r"), F.count("*").alias("n"))
    return made.select(*groups, *[F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("slope", "intercept", "r")], "n")


def poly_r2(df: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """R squared of the first and second degree; 0 where y is constant.

    Degree two adds the part of y that the centred square, freed of x, explains.
    """
    w = Window.partitionBy(*groups)
    c = complete(df, x, y).select(*groups, (F.col(x) - F.avg(x).over(w)).alias("u"), (F.col(y) - F.avg(y).over(w)).alias("v"))
    s = c.groupBy(*groups).agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in {"uu": F.col("u") ** 2, "uv": F.col("u") * F.col("v"), "vv": F.col("v") ** 2, "u3": F.col("u") ** 3, "u4": F.col("u") ** 4, "u2v": F.col("u") ** 2 * F.col("v")}.items()])
    one = F.try_divide(F.col("uv") ** 2, F.col("uu") * F.col("vv"))
    left = F.col("u4") - F.col("uu") ** 2 / F.col("n") - F.try_divide(F.col("u3") ** 2, F.col("uu"))
    also = F.col("u2v") - F.try_divide(F.col("u3") * F.col("uv"), F.col("uu"))
    two = one + F.coalesce(F.when(left > 1e-9 * F.col("u4"), also**2 / (left * F.col("vv"))), F.lit(0.0))
    flat = F.col("vv") <= 1e-12
    return s.select(*groups, F.when(flat, 0.0).otherwise(one).alias("r2_linear"), F.when(flat, 0.0).otherwise(two).alias("r2_quadratic"))


def poly_fit(df: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """``df`` with ``fit_1`` and ``fit_2``, the values of the least-squares line and parabola; without a spread in ``x``: the mean.

    The parabola is the line plus the centred square freed of both lower powers.
    """
    w = Window.partitionBy(*groups)
    made = df.withColumns({"__u": F.col(x) - F.avg(x).over(w), "__mean": F.avg(y).over(w)})
    made = made.withColumn("__uu", F.avg(F.col("__u") ** 2).over(w))
    made = made.withColumn("__q", F.col("__u") ** 2 - F.col("__uu") - F.coalesce(F.try_divide(F.avg(F.col("__u") ** 3).over(w), F.col("__uu")), F.lit(0.0)) * F.col("__u"))
    slope = F.coalesce(F.try_divide(F.avg(F.col("__u") * F.col(y)).over(w), F.col("__uu")), F.lit(0.0))
    size = F.avg(F.col("__q") ** 2).over(w)
    bend = F.when(size > 1e-9 * F.avg(F.col("__u") ** 4).over(w), F.avg(F.col("__q") * F.col(y)).over(w) / size).otherwise(0.0)
    line = F.col("__mean") + slope * F.col("__u")
    return made.withColumns({"fit_1": line, "fit_2": line + bend * F.col("__q")}).drop("__u", "__mean", "__uu", "__q")


def kendall_tau(pairs: DataFrame, groups: list[str], x: str, y: str, key: str) -> DataFrame:
    """Tau-b by comparing rows pairwise; for groups of up to a few hundred rows, see :func:`kendall_tau_sorted` beyond."""
    a, b = pairs.alias("a"), pairs.alias("b")
    on = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups]
    both = a.join(b, [*on, F.col(f"a.{key}") < F.col(f"b.{key}")] if on else F.col(f"a.{key}") < F.col(f"b.{key}"))
    sx, sy = F.signum(F.col(f"a.{x}") - F.col(f"b.{x}")), F.signum(F.col(f"a.{y}") - F.col(f"b.{y}"))
    made = both.select(*[F.col(f"a.{g}").alias(g) for g in groups], sx.alias("sx"), sy.alias("sy")).groupBy(*groups).agg(F.sum(F.col("sx") * F.col("sy")).alias("s"), F.sum(F.abs("sx")).alias("nx"), F.sum(F.abs("sy")).alias("ny"))
    return made.select(*groups, F.try_divide("s", F.sqrt(F.col("nx") * F.col("ny"))).alias("tau"))


def kendall_tau_sorted(pairs: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """Tau-b per group in n log n, by counting inversions; one group is one task's rows."""
    import numpy as np

    def swaps(v: np.ndarray) -> int:
        if len(v) < 2:
            return 0
        half = len(v) // 2
        a, b = v[:half], v[half:]
        n = swaps(a) + swaps(b)
        n += int((len(a) - np.searchsorted(np.sort(a), b, "right")).sum())
        return n

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[[x, y]].dropna().sort_values([x, y])
        n, ties = len(p), lambda c: sum(k * (k - 1) // 2 for k in p.groupby(c).size())
        n0, n1, n2, n3 = n * (n - 1) // 2, ties(x), ties(y), ties([x, y])
        s = n0 - n1 - n2 + n3 - 2 * swaps(p[y].to_numpy())
        down = math.sqrt((n0 - n1) * (n0 - n2))
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] for g in groups}, "tau": [s / down if down else None]})

    kinds = dict(pairs.dtypes)
    return pairs.groupBy(*groups).applyInPandas(run, ", ".join([f"{g} {kinds[g]}" for g in groups] + ["tau double"]))
