"""All queries of the product domain and their SQL."""

from __future__ import annotations

from . import base, catalog_queries, record_queries, text_queries, web_queries  # noqa: F401


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
