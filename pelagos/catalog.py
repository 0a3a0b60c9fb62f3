"""All registered queries."""

from __future__ import annotations

from pelagos.plans import registry


def _load() -> None:
    from pelagos.plans import codes, documents, extra, findings, more, relations, rest, source, tools, verified  # noqa: F401


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(registry.ORACLES)
