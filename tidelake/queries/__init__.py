"""Queries over the driver's tables, by family; each has its SQL for another engine."""

from __future__ import annotations

import importlib

FAMILIES = ("predicates", "aggregates", "topk", "joins", "windows_sets", "scalars", "lifecycle", "suites", "streams")


def _found() -> dict:
    out: dict = {}
    for family in FAMILIES:
        out |= importlib.import_module(f"tidelake.queries.{family}").Q.entries
    return out


def queries() -> dict:
    return {k: v[0] for k, v in _found().items()}


def oracle_sql() -> dict:
    return {k: v[1] for k, v in _found().items() if v[1]}
