"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from tidemark.plans import answers, decisions, evidence, library, matching, state, textual, wordings

MODULES = (state, textual, wordings, library, answers, matching, evidence, decisions)


def queries() -> dict:
    return {query.__name__: query for module in MODULES for query in module.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
