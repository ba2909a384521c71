"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: (module, function) of each query; a module's ORACLE is its SQL.
_MODULES = {
    "op9_token_shards": "token_shards",
    "op3_substring_dedup": "substring_dedup",
    "op2_html_extract": "html_extract",
    "op8_language_id": "lang_id",
    "op7_token_counts": "token_counts",
    "op10_bpe": "bpe",
    "op1_decontaminate": "decontaminate",
    "op4_line_dedup": "line_dedup",
    "op5_exact_dedup": "exact_dedup",
    "op6_near_dedup": "near_dedup",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"tidelake.llm.{m}"), name) for name, m in _MODULES.items()}


def oracle_sql() -> dict:
    found = {name: getattr(importlib.import_module(f"tidelake.llm.{m}"), "ORACLE", None) for name, m in _MODULES.items()}
    return {k: v for k, v in found.items() if v}
