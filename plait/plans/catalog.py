"""All queries of the graph engine by name, with their SQL where SQL can say it."""

from __future__ import annotations

from plait.plans import core, derived

QUERIES = core.QUERIES | derived.QUERIES
ORACLE_SQL = core.ORACLE_SQL | derived.ORACLE_SQL
