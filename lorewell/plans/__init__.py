"""Queries over the given tables, each beside its SQL."""

from lorewell.plans import answers, bookkeeping, ingest, stores  # noqa: F401  (they add their queries to the registry)
from lorewell.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
