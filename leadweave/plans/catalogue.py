"""All queries of the engine and their SQL."""

from __future__ import annotations

from leadweave.plans import lead_queries, more_queries, text_queries

MODULES = (lead_queries, text_queries, more_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.S.items()}
