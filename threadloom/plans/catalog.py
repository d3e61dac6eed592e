"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from threadloom.plans import general, reference

FLAGSHIP = "user_summary"
_MODULES = (general, reference)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLE.items()}
