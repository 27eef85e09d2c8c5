"""All queries of the engine and their oracle SQL."""

from __future__ import annotations

from . import agents, conversation, details, evaluation, generation, relational, retrieval, scalars  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
