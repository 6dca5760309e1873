"""All registered queries with their SQL counterparts."""

from __future__ import annotations

import importlib

MODULES = [
    "ranking_queries",
    "partner_queries",
    "check_queries",
    "group_queries",
    "compare_queries",
    "text_queries",
    "table_queries",
    "record_queries",
    "reason_queries",
    "note_queries",
    "extra_queries",
    "intake_queries",
]


def all_queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(importlib.import_module(f"quotelake.plans.{name}").QUERIES)
    return out


def all_oracles() -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(importlib.import_module(f"quotelake.plans.{name}").ORACLE)
    return out
