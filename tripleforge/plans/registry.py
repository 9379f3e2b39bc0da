"""All registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from . import answers, errors, evaluation, extras, lookups, more, ranking, streams, texts

FLAGSHIP = "lookup_top15"
_MODULES = [lookups, texts, evaluation, streams, more, answers, errors, ranking, extras]


def queries() -> dict:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
