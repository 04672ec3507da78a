"""Where queries and their SQL are registered under their names."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def named(name: str, doc: str, sql: str | None, f):
    """Register a function made in a loop."""
    f.__name__, f.__doc__ = name, doc
    return query(sql)(f)
