"""Dense linear algebra per group: what SQL can't express.

Principal components come from moments that tasks sum over their own rows, so a group
may have any number of rows, over any number of tasks; what meets in one task has the
size of the dimension squared.  The other functions run ``applyInPandas`` on groups of
at most a few hundred rows by nature (one row a period, coin or year).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronaxis.functions import vectors as V

#: Sums that a task holds before it sends them on, in values.
HELD = 8_000_000


def _apply(df: DataFrame, groups: list[str], run, extra: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.groupBy(*groups).applyInPandas(run, ", ".join([*[f"{g} {kinds[g]}" for g in groups], extra]))


def _matrix(pdf: pd.DataFrame, vec: str) -> np.ndarray:
    return np.stack(pdf[vec].to_numpy()).astype(float)


def moments(df: DataFrame, groups: list[str], vec: str = "vec", order: str | None = None) -> DataFrame:
    """``i, j, s``: sums of products of (1, the vector, ``order``) over each group's rows; summed in the tasks first."""
    kinds = dict(df.dtypes)
    extra = F.array(F.col(order).cast("double")) if order else F.array().cast("array<double>")
    long = df.select(*groups, F.concat(F.array(F.lit(1.0)), F.transform(vec, lambda x: x.cast("double")), extra).alias("__x"))

    def sums(held: dict) -> pd.DataFrame:
        rows = [(*key, i, m[i].tolist()) for key, m in held.items() for i in range(len(m))]
        return pd.DataFrame(rows, columns=[*groups, "i", "row"])

    def run(frames):
        held: dict = {}
        for pdf in frames:
            for key, part in pdf.groupby(groups, dropna=False, sort=False):
                x = _matrix(part, "__x")
                held[key] = held.get(key, 0.0) + x.T @ x
            if sum(m.size for m in held.values()) > HELD:
                yield sums(held)
                held = {}
        yield sums(held)

    made = long.mapInPandas(run, ", ".join([*[f"{g} {kinds[g]}" for g in groups], "i int, row array<double>"]))
    return made.select(*groups, "i", F.posexplode("row").alias("j", "s")).groupBy(*groups, "i", "j").agg(F.sum("s").alias("s"))


def _covariance(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(mean, scatter about the mean) of a group's moments."""
    size = int(pdf["i"].max()) + 1
    m = np.zeros((size, size))
    m[pdf["i"].to_numpy(int), pdf["j"].to_numpy(int)] = pdf["s"].to_numpy(float)
    mean = m[0, 1:] / m[0, 0]
    return mean, m[1:, 1:] - m[0, 0] * np.outer(mean, mean)


def first_component(df: DataFrame, groups: list[str], order: str, vec: str = "vec") -> DataFrame:
    """``axis``: unit first principal axis, turned so that its scores rise with ``order``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, s = _covariance(pdf)
        axis = np.linalg.eigh(s[:-1, :-1])[1][:, -1]
        if s[-1, :-1] @ axis < 0:
            axis = -axis
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] for g in groups}, "axis": [axis.tolist()]})

    return _apply(moments(df, groups, vec, order), groups, run, "axis array<double>")


def components(df: DataFrame, groups: list[str], vec: str = "vec", k: int = 2) -> DataFrame:
    """``mean, axes, explained``: the first k principal axes and their shares of the variance.

    Each axis' largest weight is positive, so results don't depend on the solver's signs.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mean, s = _covariance(pdf)
        w, v = np.linalg.eigh(s)
        axes = v[:, ::-1][:, :k].T
        axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
        share = np.maximum(w[::-1][:k], 0) / max(w.sum(), 1e-300)
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] for g in groups}, "mean": [mean.tolist()], "axes": [axes.tolist()], "explained": [share.tolist()]})

    return _apply(moments(df, groups, vec), groups, run, "mean array<double>, axes array<array<double>>, explained array<double>")


def scores(df: DataFrame, made: DataFrame, groups: list[str], keys: list[str], vec: str = "vec") -> DataFrame:
    """``keys, component, score, share``: rows of ``df`` in the space of ``made`` (see :func:`components`; one row a group)."""
    placed = df.join(made, groups)
    each = F.transform("axes", lambda a: V.dot(V.minus(F.col(vec), F.col("mean")), a))
    return placed.select(*groups, *keys, F.posexplode(F.arrays_zip(each.alias("score"), F.col("explained").alias("share"))).alias("component", "__s")).select(*groups, *keys, "component", "__s.score", "__s.share")


def component_scores(df: DataFrame, groups: list[str], key: str, vec: str = "vec", k: int = 2, fitted: str | None = None) -> DataFrame:
    """``key, component, score, share`` of the first k components; with ``fitted`` (a boolean column), other rows are projected into the fitted rows' space."""
    own = df if fitted is None else df.filter(F.col(fitted))
    return scores(df, components(own.select(*groups, vec), groups, vec, k), groups, [key], vec)


def min_norm_axis(df: DataFrame, groups: list[str], target: str, vec: str = "vec") -> DataFrame:
    """``axis``: unit minimum-norm least-squares direction of the centred target on the centred vectors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = _matrix(pdf, vec), pdf[target].to_numpy(float)
        d = np.linalg.pinv(x - x.mean(0)) @ (y - y.mean())
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] for g in groups}, "axis": [(d / (np.linalg.norm(d) + 1e-12)).tolist()]})

    return _apply(df, groups, run, "axis array<double>")


def classical_mds(df: DataFrame, groups: list[str], key: str, vec: str = "vec") -> DataFrame:
    """``key, x, y, stress``: classical scaling of standard-scored points to two dimensions; under four points: no rows."""
    kind = dict(df.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = _matrix(pdf, vec)
        sd = x.std(0)
        x = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
        d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0))
        n = len(x)
        if n < 4:
            return pd.DataFrame({**{g: [] for g in groups}, key: [], "x": [], "y": [], "stress": []})
        j = np.eye(n) - 1 / n
        w, v = np.linalg.eigh(-j @ (d**2) @ j / 2)
        p = v[:, ::-1][:, :2] * np.sqrt(np.maximum(w[::-1][:2], 0))
        p *= np.where(p[np.abs(p).argmax(0), [0, 1]] < 0, -1, 1)
        e = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] * n for g in groups}, key: pdf[key], "x": p[:, 0], "y": p[:, 1], "stress": ((d - e) ** 2).sum() / 2})

    return _apply(df, groups, run, f"{key} {kind}, x double, y double, stress double")


def peaks(df: DataFrame, groups: list[str], order: str, value: str, share: float = 0.8) -> DataFrame:
    """Local maxima whose prominence is at least ``share`` of the population deviation."""
    kind = dict(df.dtypes)[order]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value]).sort_values(order)
        v = pdf[value].to_numpy(float)
        out, i = [], 1
        while i < len(v) - 1:
            j = i
            while j < len(v) - 1 and v[j + 1] == v[i]:
                j += 1
            if v[i - 1] < v[i] and j < len(v) - 1 and v[j + 1] < v[i]:
                at = (i + j) // 2
                left = next((k for k in range(at, -1, -1) if v[k] > v[at]), -1)
                right = next((k for k in range(at, len(v)) if v[k] > v[at]), len(v))
                prominence = v[at] - max(v[left + 1 : at + 1].min(), v[at:right].min())
                if prominence >= share * v.std():
                    out.append((at, prominence))
            i = j + 1
        at = [a for a, _ in out]
        return pd.DataFrame({**{g: [pdf[g].iloc[0]] * len(out) if out else [] for g in groups}, order: pdf[order].to_numpy()[at] if out else [], "peak": v[at] if out else [], "prominence": [p for _, p in out]})

    return _apply(df, groups, run, f"{order} {kind}, peak double, prominence double")
