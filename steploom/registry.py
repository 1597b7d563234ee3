"""All queries of the reasoning-trace operators, by name, and their SQL."""

from __future__ import annotations

from .plans import decisions, files, ordering, scalars, spantrees, statistics, studies, texts  # noqa: F401  each registers its queries
from .plans.base import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
