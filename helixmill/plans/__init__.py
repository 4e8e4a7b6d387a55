"""Registered queries over the given tables, each with its SQL where SQL can say it."""

from helixmill.plans import context_queries, fiber_queries, inference_queries, sequence_queries, stat_queries, table_queries
from helixmill.plans.registry import oracle_sql, queries

__all__ = ["context_queries", "fiber_queries", "inference_queries", "oracle_sql", "queries", "sequence_queries", "stat_queries", "table_queries"]
