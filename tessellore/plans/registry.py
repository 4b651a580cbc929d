"""All queries of the library engine."""

from __future__ import annotations

from tessellore.plans import align_queries, function_queries, library_queries, literal_queries, page_queries, store_queries, text_queries
from tessellore.plans.base import Query

PARTS = (library_queries.R, text_queries.R, literal_queries.R, page_queries.R, align_queries.R, store_queries.R, function_queries.R)


def queries() -> dict[str, Query]:
    return {name: fn for part in PARTS for name, fn in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.sql.items()}
