"""Registered queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from sparkloom.plans import catalog_queries, chat_queries, kpi_queries, relational_queries, source_queries, text_queries  # noqa: F401  (they register themselves)
from sparkloom.plans.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES", "query", "table"]
