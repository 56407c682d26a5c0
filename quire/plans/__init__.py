"""Queries over the project's tables, with SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module
from pkgutil import iter_modules


def _gather(name: str) -> dict:
    out: dict = {}
    for m in sorted(x.name for x in iter_modules(__path__)):
        out |= getattr(import_module(f"{__name__}.{m}"), name, {})
    return out


def all_queries() -> dict:
    return _gather("QUERIES")


def all_sql() -> dict:
    return _gather("SQL")
