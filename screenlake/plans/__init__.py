"""Registered queries: one per operator, with the SQL they are held against."""

from . import evidence_queries, join_queries, metric_queries, model_queries, trace_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
