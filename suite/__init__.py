"""Registered queries: importing this package fills the registry."""

from suite import model_queries, panel_queries, series_queries, source_queries  # noqa: F401
from suite.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
