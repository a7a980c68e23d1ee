"""All queries of the engine and, by the same names, their SQL."""

from __future__ import annotations

from evidora.plans import dedup, details, evidence, files, governance, operations, reporting, round_trips, search, texts  # noqa: F401  they register their queries
from evidora.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
