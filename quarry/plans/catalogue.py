"""All queries of the engine."""

from quarry.plans import content, review, state, structure, work  # noqa: F401
from quarry.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
