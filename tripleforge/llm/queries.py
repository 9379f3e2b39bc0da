"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import importlib

#: Module, query function; a module's SQL, where it has one, belongs to its query.
_MODULES = [
    ("decontamination", "op4_decontamination"),
    ("toxicity", "op2_toxicity"),
    ("ngram_join", "op1_ngram_join"),
    ("pii", "op3_pii"),
    ("exact_dedup", "op5_exact_dedup"),
    ("substring_dedup", "op8_substring_dedup"),
    ("quality", "op6_quality"),
    ("license_scan", "op7_license_scan"),
    ("mixing", "op9_mix_sources"),
    ("url_filter", "op10_url_filter"),
]


def llm_queries() -> dict:
    out = {}
    for module, name in _MODULES:
        out[name] = getattr(importlib.import_module(f"{__package__}.{module}"), name)
    return out


def llm_oracle_sql() -> dict[str, str]:
    out = {}
    for module, name in _MODULES:
        sql = getattr(importlib.import_module(f"{__package__}.{module}"), "SQL", None)
        if sql:
            out[name] = sql
    return out
