"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pelagos.plans import views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def sql_with_views(sql: str) -> str:
    """``sql`` after the views; it may begin with tables of its own (``name AS (...), ... SELECT``)."""
    head = "WITH RECURSIVE " + ",\n".join(f"{name} AS ({body})" for name, body in views.SQL.items())
    return f"{head}\n{'' if sql.lstrip().upper().startswith('SELECT') else ','}{sql}"


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` gives the same rows over the same tables."""

    def keep(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql_with_views(sql)
        return f

    return keep


def cases(column: str, values: dict, default: str) -> str:
    """A CASE over a fixed table, for SQL."""
    show = lambda v: f"'{v}'" if isinstance(v, str) else repr(v) + ("::DOUBLE" if isinstance(v, float) else "")
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in values.items()) + f" ELSE {default} END"
