"""All registered queries and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["retrieval", "corpus", "evaluation", "answers", "sampling", "monitoring", "streams"]


def _load(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(importlib.import_module(f"provena.plans.{m}"), attr))
    return out


def queries() -> dict:
    return _load("QUERIES")


def oracle_sql() -> dict:
    return _load("SQL")
