"""Importing this module registers every query."""

from tablewright.plans import (  # noqa: F401
    aggregation,
    changes,
    checks,
    fields,
    joins,
    paging,
    predicates,
    selection,
    setops,
    subqueries,
)
from tablewright.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
