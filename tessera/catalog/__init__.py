"""Queries over the driver's tables, one per operator, with their results in SQL where it can express them."""

from __future__ import annotations

from tessera.catalog import links, search, texts, trials, upkeep  # noqa: F401
from tessera.catalog.base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
