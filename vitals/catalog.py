"""Queries by name, and the SQL that each is held against."""

from vitals.plans import facts, measures  # noqa: F401  registers them
from vitals.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
