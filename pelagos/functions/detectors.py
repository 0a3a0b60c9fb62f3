"""Detectors as table functions: text in, rows out, registered by name; one that fails gives an error row, not a failed job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

#: name -> function of a text that yields (rule, line, message).
REGISTRY: dict[str, Callable[[str], Iterator[tuple[str, int, str]]]] = {}


def detector(name: str):
    """Register a detector under ``name``."""

    def keep(f):
        REGISTRY[name] = f
        return f

    return keep


@detector("long-lines")
def long_lines(text: str) -> Iterator[tuple[str, int, str]]:
    for i, line in enumerate(text.split("\n"), 1):
        if len(line) > 120:
            yield "long-line", i, f"{len(line)} characters"


@detector("todo")
def todo(text: str) -> Iterator[tuple[str, int, str]]:
    for i, line in enumerate(text.split("\n"), 1):
        if "TODO" in line or "FIXME" in line:
            yield "todo", i, line.strip()[:100]


def guarded(f: Callable) -> Callable:
    """``f`` with an error row in place of an exception."""

    def run(text: str | None) -> Iterator[tuple[str, int, str]]:
        try:
            yield from f(text or "")
        except Exception as e:  # a detector is foreign code: its failure is a row of the result
            yield "error", 0, f"{type(e).__name__}: {e}"[:200]

    return run


def register(spark: SparkSession, more: dict[str, Callable] | None = None) -> list[str]:
    """Make every detector, and those of ``more``, a table function ``detect_<name>(text)`` of the session; returns the names."""
    from pyspark.sql.functions import udtf

    out = []
    for name, f in (REGISTRY | (more or {})).items():
        run = guarded(f)

        class Rows:
            body = staticmethod(run)

            def eval(self, text: str):
                yield from self.body(text)

        sql_name = f"detect_{name.replace('-', '_')}"
        spark.udtf.register(sql_name, udtf(Rows, returnType="rule string, line int, message string"))
        out.append(sql_name)
    return out
