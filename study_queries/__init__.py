"""Queries over the driver's tables, one or more per operator of the library."""

from study_queries.registry import ORACLE, QUERIES
from study_queries import lookups, cohort_queries, shaping, tables, models  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
