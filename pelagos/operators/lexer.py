"""What in source text is code: strings and comments masked in place, and the scopes that braces open.

One alternation over strings, line comments and block comments decides which of them begins first, so that marks of
one inside another mean nothing. Masking keeps every line end and every offset. Scopes are read off the masked text
in one pass with a stack, one document at a time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRING = r"{q}[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+{q}?+"
#: Strings in either quotes, which end at their line's end at the latest; line comments; block comments, closed or not.
LEX = "|".join((_STRING.format(q='"'), _STRING.format(q="'"), r"//[^\n]*+", r"/\*[\s\S]*?(?:\*/|\z)"))


def masked(code: Column, strings: bool = True) -> Column:
    """``code`` with blanks for comments and, if ``strings``, for what is between quotes; null stays null."""
    blank = lambda t: F.regexp_replace(t, r"[^\n]", " ")

    def mask(t: Column) -> Column:
        quote = F.substring(t, 1, 1)
        closed = (F.length(t) > 1) & (F.substring(t, -1, 1) == quote)
        inside = F.repeat(F.lit(" "), F.length(t) - F.when(closed, 2).otherwise(1))
        text = F.concat(quote, inside, F.when(closed, quote).otherwise("")) if strings else t
        return F.when(quote == "/", blank(t)).otherwise(text)

    marks = F.transform(F.regexp_extract_all(code, F.lit(LEX), F.lit(0)), mask)
    return F.array_join(F.zip_with(F.split(code, LEX, -1), marks, lambda gap, mark: F.concat(gap, F.coalesce(mark, F.lit("")))), "")


WORDS = re.compile(r"[;{}]|\b(?:contract|interface|library|function|modifier|constructor|fallback|receive)\b")
NAME = re.compile(r"\w+\s+([A-Za-z_$][\w$]*)")
BRACKET = re.compile(r"\w+\s*\(")
HOLDERS = ("contract", "interface", "library")


class Scope(NamedTuple):
    """A pair of braces: what opens it, the scope it lies in (-1: none), where its head, its brace and its end are."""

    kind: str
    name: str
    parent: int
    depth: int
    start: int
    opens: int
    closes: int


def outline(code: str) -> list[Scope]:
    """The scopes of masked ``code`` in the order of their braces; those not closed run to the end.

    A head counts outside of functions only: inside, the same words are types, variables or calls.
    """
    out: list[list] = []
    stack: list[int] = []
    head = None
    for m in WORDS.finditer(code):
        mark = m[0]
        if mark == "{":
            kind, name, start = head or ("block", "", m.start())
            out.append([kind, name, stack[-1] if stack else -1, len(stack), start, m.start(), len(code)])
            stack.append(len(out) - 1)
            head = None
        elif mark == "}":
            if stack:
                out[stack.pop()][6] = m.start()
            head = None
        elif mark == ";":
            head = None
        elif head is None and not (stack and out[stack[-1]][0] not in HOLDERS):
            named = NAME.match(code, m.start())
            if mark in ("constructor", "fallback", "receive"):
                head = (mark, mark, m.start()) if BRACKET.match(code, m.start()) else None
            elif mark == "function":
                head = (mark, named[1] if named else "fallback", m.start())
            elif named:
                head = (mark, named[1], m.start())
    return [Scope(*s) for s in out]


def is_function(scope: Scope) -> bool:
    return scope.kind not in HOLDERS and scope.kind != "block"


def lines_of(code: str) -> list[int]:
    """Where the lines of ``code`` begin."""
    return [0, *[m.end() for m in re.finditer("\n", code)]]


def by_document(docs: DataFrame, key: str, text: str, rows_of, schema: str) -> DataFrame:
    """``rows_of(masked code)``, tuples after ``schema``, for every document, each after the document's key."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k.as_py(), *r) for k, t in zip(batch.column(0), batch.column(1), strict=True) for r in rows_of(t.as_py() or "")]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), *[kinds[f[1]] for f in fields]], strict=True)], [key, *[f[0] for f in fields]])

    return docs.select(F.col(key).cast("long"), masked(F.col(text)).alias("code")).mapInArrow(run, f"{key} long, {schema}")


def scopes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, scope, parent, kind, name, depth, first_line, last_line)`` of all scopes, nested ones too."""

    def rows(code: str) -> Iterator[tuple]:
        starts = lines_of(code)
        for i, s in enumerate(outline(code)):
            yield i, s.parent, s.kind, s.name, s.depth, bisect_right(starts, s.start), bisect_right(starts, min(s.closes, max(len(code) - 1, 0)))

    return by_document(docs, key, text, rows, "scope int, parent int, kind string, name string, depth int, first_line int, last_line int")


def functions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, holder, name, first_line, last_line, head, body)`` of every function-like block, in masked code; ``holder`` is
    the contract around it, empty if there is none."""

    def rows(code: str) -> Iterator[tuple]:
        starts, found = lines_of(code), outline(code)
        for s in filter(is_function, found):
            last = bisect_right(starts, min(s.closes, max(len(code) - 1, 0)))
            yield found[s.parent].name if s.parent >= 0 else "", s.name, bisect_right(starts, s.start), last, code[s.start : s.opens].strip(), code[s.opens + 1 : s.closes]

    return by_document(docs, key, text, rows, "holder string, name string, first_line int, last_line int, head string, body string")


LOOPS = re.compile(r"\b(?:for|while)\s*\(")
ROUND, CURLY, STOP = re.compile(r"[()]"), re.compile(r"[{}]"), re.compile(r"[;{]")


def closing(code: str, at: int, marks: re.Pattern) -> int:
    """Where the bracket that opens at ``at`` closes; the end if it does not."""
    depth = 0
    for m in marks.finditer(code, at):
        depth += 1 if m[0] in "({" else -1
        if not depth:
            return m.start()
    return len(code)


def loops_of(body: str) -> Iterator[tuple[int, str, str]]:
    """Where the loops of masked ``body`` begin, their heads and their bodies, inner loops too; without braces the
    body is one statement."""
    for m in LOOPS.finditer(body):
        end = closing(body, m.end() - 1, ROUND)
        stop = STOP.search(body, end)
        if not stop:
            yield m.start(), body[m.end() : end], body[end + 1 :]
        elif stop[0] == ";" or body[end + 1 : stop.start()].strip():  # a brace of call options
            semicolon = body.find(";", end)
            yield m.start(), body[m.end() : end], body[end + 1 : semicolon if semicolon >= 0 else len(body)]
        else:
            yield m.start(), body[m.end() : end], body[stop.end() : closing(body, stop.start(), CURLY)]


def loops(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, name, line, head, body)`` of every loop, ``name`` that of the function around it."""

    def rows(code: str) -> Iterator[tuple]:
        starts = lines_of(code)
        for s in filter(is_function, outline(code)):
            for at, head, body in loops_of(code[s.opens + 1 : s.closes]):
                yield s.name, bisect_right(starts, s.opens + 1 + at), head, body

    return by_document(docs, key, text, rows, "name string, line int, head string, body string")


def with_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, code, first, last)``: masked code, and the first and last lines of its functions as two lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = [], []
            for t in batch.column(1):
                code = t.as_py() or ""
                starts, found = lines_of(code), [s for s in outline(code) if is_function(s)]
                first.append([bisect_right(starts, s.start) for s in found])
                last.append([bisect_right(starts, min(s.closes, max(len(code) - 1, 0))) for s in found])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(first, pa.list_(pa.int32())), pa.array(last, pa.list_(pa.int32()))], [key, "code", "first", "last"])

    return docs.select(F.col(key).cast("long"), masked(F.col(text)).alias("code")).mapInArrow(run, f"{key} long, code string, first array<int>, last array<int>")
