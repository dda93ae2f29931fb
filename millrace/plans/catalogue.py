"""All registered queries."""

from millrace.plans import dialect_queries, relational, scenarios, stateful  # noqa: F401  each registers its own
from millrace.plans.registry import QUERIES, Query

__all__ = ["QUERIES", "Query"]
