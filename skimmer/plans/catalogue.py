"""All queries of the engine, by name, and their SQL counterparts."""

from __future__ import annotations

from skimmer.plans import ranking_queries, source_queries, store_queries, stored_queries, stream_queries, text_queries, update_queries  # noqa: F401
from skimmer.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
