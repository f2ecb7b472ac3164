"""Queries of the operators and the SQL that must give the same rows."""

from __future__ import annotations

from strandline.queries import interval_queries, media_queries, relational_queries, search_queries, text_queries  # noqa: F401
from strandline.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
