"""The registered queries and their SQL."""

from __future__ import annotations

from chronaxis.plans import figure_plans, linear_plans, metric_plans, series_plans, source_plans, vector_plans
from chronaxis.plans.registry import Query

_MODULES = (series_plans, vector_plans, linear_plans, metric_plans, figure_plans, source_plans)


def queries() -> dict[str, Query]:
    return {k: v for m in _MODULES for k, v in m.register.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.register.sql.items()}
