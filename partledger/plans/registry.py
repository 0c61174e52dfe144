"""Collects the query modules: each has QUERIES (name to function) and ORACLE_SQL (name to SQL)."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("supply", "activity", "entities", "texts", "flows", "curation", "scalars", "validation", "products", "names", "extraction", "captions", "nested", "reports", "snapshots", "discovery", "scores", "costs")


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"partledger.plans.{name}"), attribute)
        if clash := found.keys() & part.keys():
            raise ValueError(f"query names registered twice: {sorted(clash)}")
        found.update(part)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")
