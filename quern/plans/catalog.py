"""All registered queries outside ``llm``, with their DuckDB counterparts."""

from __future__ import annotations

from . import enrichment, features, landing, learning, modelling, postings, retrieving, statistics, tables
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "enrichment", "features", "landing", "learning", "modelling", "postings", "retrieving", "statistics", "tables"]
