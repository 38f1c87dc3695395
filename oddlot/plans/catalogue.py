"""All registered queries."""

from oddlot.plans import basic_queries, feature_queries, model_queries  # noqa: F401
from oddlot.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
