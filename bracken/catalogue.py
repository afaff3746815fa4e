"""All registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

from .plans.registered import QUERIES, SQL, flagship


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["flagship", "oracle_sql", "queries"]
