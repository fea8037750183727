"""The adapter from the driver tables to canonical tables, and the registered queries with their SQL."""

from . import details, household, ingesting, reading, reporting, runs, scheduling, streams, understanding, verifying  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
