"""All named queries over the fixture tables, and the SQL twins that they are held against."""

from __future__ import annotations

from tessera.plans import analytics, dreaming, editing, growth, insight, network, retrieval, upkeep  # noqa: F401  they register their queries
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
