"""SQL for what the linear-algebra and test queries compute, by routes of its own.

Principal axes come from squaring the scatter matrix again and again, p-values from the
finite sums of Student's t, linear systems from elimination.  Texts go after ``with
recursive``.
"""

from __future__ import annotations

SQUARINGS = 36


def r6(expr: str, name: str) -> str:
    return f"round(round({expr}, 9), 6) + 0.0 as {name}"


def axes_sql(p: str, source: str, keys: str, ids: str, k: int, where: str = "true") -> str:
    """CTEs ``{p}mean (keys, mean)`` and ``{p}ax (keys, c, axis, share)`` of a long table ``keys, ids, pos, v``; axes have no sign yet."""
    n = "range(len(m))"
    parts = [
        f"{p}mu as (select {keys}, pos, avg(v) as mu from {source} where {where} group by all)",
        f"{p}mean as (select {keys}, list(mu order by pos) as mean from {p}mu group by {keys})",
        f"{p}col as (select {keys}, pos, list(v - mu order by {ids}) as x from (select * from {source} where {where}) join {p}mu using ({keys}, pos) group by {keys}, pos)",
        f"{p}row as (select {keys}, a.pos as i, list(list_dot_product(a.x, b.x) order by b.pos) as r from {p}col a join {p}col b using ({keys}) group by {keys}, a.pos)",
        f"{p}m1 as (select {keys}, list(r order by i) as m from {p}row group by {keys})",
        f"{p}tot as (select {keys}, list_sum(list_transform({n}, lambda i: m[i + 1][i + 1])) as total from {p}m1)",
    ]
    for c in range(1, k + 1):
        parts += [
            f"""{p}s{c} as (select {keys}, 0 as step, m from {p}m{c} union all select {keys}, step + 1, list_transform(s, lambda r: list_transform(r, lambda x: x / t)) from (
              select *, list_sum(list_transform(range(len(s)), lambda i: s[i + 1][i + 1])) as t from (select {keys}, step, list_transform(m, lambda r: list_transform(m, lambda q: list_dot_product(r, q))) as s from {p}s{c} where step < {SQUARINGS})))""",
            f"{p}v{c} as (select {keys}, list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) as axis from (select {keys}, m[list_position(d, list_max(d))] as r from (select {keys}, m, list_transform({n}, lambda i: m[i + 1][i + 1]) as d from {p}s{c} where step = {SQUARINGS})))",
            f"{p}l{c} as (select {keys}, axis, list_dot_product(axis, list_transform(m, lambda r: list_dot_product(r, axis))) as lam, m from {p}v{c} join {p}m{c} using ({keys}))",
            f"{p}m{c + 1} as (select {keys}, list_transform({n}, lambda i: list_transform({n}, lambda j: m[i + 1][j + 1] - lam * axis[i + 1] * axis[j + 1])) as m from {p}l{c})",
        ]
    union = " union all ".join(f"select {keys}, {c - 1} as c, axis, lam from {p}l{c}" for c in range(1, k + 1))
    return ", ".join([*parts, f"{p}ax as (select {keys}, c, axis, lam / total as share from ({union}) join {p}tot using ({keys}))"])


def flipped(cond: str, axis: str = "axis") -> str:
    return f"case when {cond} then list_transform({axis}, lambda x: -x) else {axis} end"


def weighed_sql(p: str, keys: str) -> str:
    """CTE ``{p}pc``: the axes of :func:`axes_sql` with the largest weight positive."""
    size = "list_transform(axis, lambda x: abs(x))"
    return f"{p}pc as (select {keys}, c, {flipped(f'axis[list_position({size}, list_max({size}))] < 0')} as axis, share from {p}ax)"


def risen_sql(p: str, points: str, keys: str, order: str) -> str:
    """CTE ``{p}up (keys, axis)``: the first axis turned so that scores of ``points`` (``keys, vec, order``) rise."""
    return f"{p}up as (select {keys}, {flipped(f'covar_pop(list_dot_product(vec, axis), {order}) < 0')} as axis from {points} join {p}ax using ({keys}) where c = 0 group by {keys}, axis)"


def minus_sql(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda t: t[1] - t[2])"


def scores_sql(p: str, points: str, keys: str, ids: str) -> str:
    """Rows ``keys, ids, component, score, share`` of ``points`` on ``{p}pc``."""
    return f"select {keys}, {ids}, c as component, list_dot_product({minus_sql('vec', 'mean')}, axis) as score, share from {points} join {p}mean using ({keys}) join {p}pc using ({keys})"


def p_sql(rho: str, n: str) -> str:
    """Two-sided p of a correlation: the finite sum of Student's t with whole degrees of freedom."""
    def series(odd: bool) -> str:
        top, factor = ("(n0 - 3) // 2", "(2.0 * j) / (2 * j + 1)") if odd else ("(n0 - 2) // 2", "(2.0 * j - 1) / (2 * j)")
        return f"list_sum(list_transform(range({top} + 1), lambda k: (1 - r0 * r0) ** k * coalesce(list_product(list_transform(range(1, k + 1), lambda j: {factor})), 1)))"

    body = f"""case when n0 < 1 or r0 is null then null when abs(r0) >= 1 then 0.0 when n0 = 1 then 1 - 2 / pi() * asin(abs(r0))
      when n0 % 2 = 1 then 1 - 2 / pi() * (asin(abs(r0)) + abs(r0) * sqrt(1 - r0 * r0) * {series(True)}) else 1 - abs(r0) * {series(False)} end"""
    return body.replace("n0", f"({n} - 2)").replace("r0", f"({rho})")


def solve_sql(p: str, source: str, keys: str, n: int) -> str:
    """CTE ``{p}x (keys, x)``: solutions of symmetric positive systems ``source (keys, m)``, whose rows are n numbers and the right side."""
    step = f"""select {keys}, k + 1, list_transform(range(1, {n + 1}), lambda i: case when i = k + 1 then list_transform(m[k + 1], lambda z: z / m[k + 1][k + 1])
      else list_transform(list_zip(m[i], m[k + 1]), lambda t: t[1] - t[2] * m[i][k + 1] / m[k + 1][k + 1]) end) from {p}g where k < {n}"""
    return f"{p}g as (select {keys}, 0 as k, m from {source} union all {step}), {p}x as (select {keys}, list_transform(m, lambda r: r[{n + 1}]) as x from {p}g where k = {n})"
