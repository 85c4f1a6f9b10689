"""Registry of the analytic queries and their oracle SQL."""

from __future__ import annotations

from . import cost_queries, event_queries, graph_queries, relational_queries, rule_queries, stats_queries, summary_queries, text_queries  # noqa: F401  they register
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
