"""All queries of the core, by name, and the SQL that checks them."""

from __future__ import annotations

from ledgerloom.plans import data_checks, reference_queries

QUERIES = {**data_checks.QUERIES, **reference_queries.QUERIES}
ORACLES: dict[str, str] = {**data_checks.ORACLES, **reference_queries.ORACLES}
ENTRY = reference_queries.reconcile_status
