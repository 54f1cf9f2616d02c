"""All queries over the driver tables, with their SQL."""

from __future__ import annotations

from . import component_queries, factor_queries, numeric_queries, queries as base, shape_queries  # noqa: F401  they add to the same tables


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
