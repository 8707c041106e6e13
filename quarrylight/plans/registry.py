"""All registered queries of the core: name -> callable, and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (session, folder) under its own name, with its SQL twin if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


for _name in ("pages", "texts", "matching", "evidence", "reports", "events", "checks", "files", "applicability", "proposals", "linters", "discovery", "resolution", "records", "details"):
    import_module(f"quarrylight.plans.{_name}")
