"""All queries of the core library with their oracle SQL."""

from __future__ import annotations

from .catalog import audit, learning, metrics, serving, text  # noqa: F401  (each module registers its queries)
from .catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
