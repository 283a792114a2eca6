"""All registered queries of the library and their SQL."""

from __future__ import annotations

from ledgerloom.plans import queries_core, queries_design, queries_estimates, queries_joins, queries_models, queries_more, queries_streams, queries_text
from ledgerloom.plans.register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "queries_core", "queries_design", "queries_estimates", "queries_joins", "queries_models", "queries_more", "queries_streams", "queries_text"]
