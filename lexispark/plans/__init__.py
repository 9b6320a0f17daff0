"""Runnable queries over the given tables, each with its reference SQL."""

from lexispark.plans import audit, load, pairs, phrases, publish, retrieval, search, spans  # noqa: F401
from lexispark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
