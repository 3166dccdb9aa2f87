"""All queries by name, with equivalent SQL."""

from __future__ import annotations

from traceloom.plans import audits, differences, families, invariants, programs, reports, sets, stores, timelines, traces, verdicts

MODULES = (traces, differences, timelines, verdicts, invariants, programs, sets, reports, families, audits, stores)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
