"""All queries of the recommendation engine, and their SQL."""

from __future__ import annotations

from tessera.plans import catalogue, text_queries

QUERIES = catalogue.QUERIES | text_queries.QUERIES
ORACLES = catalogue.ORACLES | text_queries.ORACLES
