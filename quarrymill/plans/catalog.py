"""All registered queries."""

from quarrymill.plans import coach_queries, filter_queries, function_queries, pipeline_queries, relation_queries, stats_queries, vector_queries  # noqa: F401
from quarrymill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
