"""All flow queries and their SQL."""

from __future__ import annotations

from .plans import flow_queries, geo_queries, io_queries, model_queries, report_queries  # noqa: F401
from .plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
