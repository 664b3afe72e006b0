"""Registry of the engine's queries and their DuckDB counterparts."""

from __future__ import annotations

from evalloom.plans import agreement, corpus, items, neighbours, panel, profile, records, runs, texts, topup
from evalloom.plans.registry import QUERIES, SQL

MODULES = (profile, panel, texts, records, corpus, neighbours, agreement, runs, topup, items)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
