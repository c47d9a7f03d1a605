"""The registered queries of the discussion engine and their oracle SQL."""

from __future__ import annotations

from threadloom.plans import forests, models, preferences, ranking, reports, tables, texts  # noqa: F401
from threadloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["QUERIES", "ORACLE_SQL"]
