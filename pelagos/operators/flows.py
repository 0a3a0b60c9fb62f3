"""Flows of values through source text and intermediate code.

Taint is sensitive to order: statements of a function are rows, each use of a variable meets the latest definition
before it (a last value over the statements that touch the variable), and only along those edges labels spread. A
variable that has been assigned something clean is clean, and a check counts as a definition that carries what it
checks, marked as checked. Branches are read as they stand in the text: what a branch assigns holds after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagos import session

NAME = r"[A-Za-z_$][\w$]*"
#: Where foreign values come from: label and what it looks like. Parameters of functions are one more.
SOURCES = {
    "msg.sender": r"\bmsg\.sender\b", "msg.value": r"\bmsg\.value\b", "msg.data": r"\bmsg\.data\b", "tx.origin": r"\btx\.origin\b",
    "block.timestamp": r"\b(?:block\.timestamp|now)\b", "block.number": r"\bblock\.number\b", "block.coinbase": r"\bblock\.coinbase\b",
}
PARAMETER = "function_parameter"
#: What must not get them; those of HIGH are worse.
SINKS = {
    "call": r"\.call\s*[{(]", "delegatecall": r"\.delegatecall\s*[{(]", "staticcall": r"\.staticcall\s*[{(]", "transfer": r"\.transfer\s*\(", "send": r"\.send\s*\(",
    "selfdestruct": r"\b(?:selfdestruct|suicide)\s*\(",
}
HIGH = ("call", "delegatecall", "selfdestruct")
CRITICAL = ("msg.data", PARAMETER)
CHECK = r"^\s*(?:(?:require|assert)\s*\(|if\s*\([^)]*[=!<>])"
#: An assignment: type words, the variable, indexes and members of it, the operator of a compound one, what follows the sign.
ASSIGNED = rf"^\s*(?:[\w.$]+(?:\[[^\]]*\])*\s+)*?({NAME})((?:\[[^\]]*\]|\.\w+)*)\s*([-+*/%|&^]|<<|>>)?=([^=>]|$)"
#: Braces of call options, which end no statement; the parts of a loop's head, which are one.
OPTIONS, LOOP = r"\{\s*((?:value|gas|salt)\s*:[^{}]*)\}", r"(for\s*\([^;{}]*);([^;{}]*);([^{}]*?\))"
FREE = rf"(?:^|[^\w$.])({NAME})"
NO_NAMES = ("if", "else", "for", "while", "do", "require", "assert", "return", "emit", "new", "delete", "revert", "true", "false", "this", "now", "msg", "tx", "block", "address", "uint", "uint256", "int", "bool", "bytes", "string", "memory", "storage", "calldata", "payable")


def parameters(head: Column) -> Column:
    """Names of a function's parameters: the last words of the parts of its first bracket."""
    inside = F.regexp_extract(head, r"^[^(]*\(([^)]*)\)", 1)
    names = F.transform(F.split(inside, ","), lambda p: F.regexp_extract(p, rf"\s({NAME})(?:\[\])?\s*$", 1))
    return F.filter(names, lambda n: n != "")


def statements(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, first_line, n, text, value, target, keeps, names)`` of the statements of ``blocks`` (functions as the lexer cuts
    them): ``n`` counts from 0, ``target`` is the variable assigned, ``value`` what it gets (without one: all), ``keeps``
    says that its former value counts too (compound assignments, elements, members), ``names`` are the variables used."""
    text = F.regexp_replace(F.regexp_replace("body", OPTIONS, "($1)"), LOOP, "$1,$2,$3")
    parts = blocks.select(key, "first_line", F.posexplode(F.split(text, r"[;{}]", -1)).alias("n", "text")).where("trim(text) <> ''")
    part = lambda i: F.regexp_extract("text", ASSIGNED, i)
    value = F.regexp_replace("text", ASSIGNED, " $4")
    names = lambda c: F.regexp_extract_all(c, F.lit(FREE), F.lit(1))
    used = F.array_except(F.array_distinct(F.concat(names(value), names(part(2)))), F.array(*map(F.lit, NO_NAMES)))
    return parts.select(key, "first_line", "n", "text", value.alias("value"), F.when(part(1) != "", part(1)).alias("target"), ((part(2) != "") | (part(3) != "")).alias("keeps"), used.alias("names"))


def definitions_and_uses(blocks: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``defs(key, first_line, n, var, checked, source)`` and ``uses(key, first_line, n, var, by, text, def)``: ``by`` is the
    variable a use helps to define (null: none), ``def`` the number of the definition that it meets."""
    session.ensure_checkpoint_dir(blocks.sparkSession)
    rows = statements(blocks, key).checkpoint()
    here = [key, "first_line"]
    check = F.col("text").rlike(CHECK)
    known = F.array_compact(F.array(*[F.when(F.col("value").rlike(p), F.lit(label)) for label, p in SOURCES.items()]))
    assigned = rows.where("target is not null").select(*here, "n", F.col("target").alias("var"), F.lit(False).alias("checked"), known.alias("source"))
    params = blocks.select(*here, F.lit(-1).alias("n"), F.explode(parameters(F.col("head"))).alias("var"), F.lit(False).alias("checked"), F.array(F.lit(PARAMETER)).alias("source"))
    seen = rows.where(check & F.col("target").isNull()).select(*here, "n", F.explode("names").alias("var"), F.lit(True).alias("checked"), F.array().cast("array<string>").alias("source"))
    defs = assigned.unionByName(params).unionByName(seen).checkpoint()
    own = F.when(F.col("target").isNotNull() & F.col("keeps"), F.array_union("names", F.array("target"))).otherwise(F.col("names"))
    plain = rows.select(*here, "n", "text", "target", check.alias("check"), F.explode(own).alias("var"))
    used = plain.select(*here, "n", "text", "var", F.when(F.col("check") & F.col("target").isNull(), F.col("var")).otherwise(F.col("target")).alias("by"))
    marks = defs.select(*here, "n", "var", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("by"), F.lit(None).cast("string").alias("text"))
    both = marks.unionByName(used.select(*here, "n", "var", F.lit(0).alias("kind"), "by", "text"))
    before = Window.partitionBy(*here, "var").orderBy("n", "kind").rowsBetween(Window.unboundedPreceding, -1)
    met = both.withColumn("def", F.last(F.when(F.col("kind") == 1, F.col("n")), True).over(before))
    return defs, met.where("kind = 0").drop("kind")


def tainted(blocks: DataFrame, key: str = "doc_id", rounds: int = 100) -> DataFrame:
    """``(key, first_line, n, sink, variable, source, checked, severity)``: variables that reach a sink, statement ``n`` of its
    function, with a foreign value, and where it comes from; ``checked`` if every way there passes a check. A source that
    stands in the sink's statement itself is a variable of its name.

    Labels spread over the edges of definitions, new ones only in each round; definitions look back, so that the edges
    have no cycle and rounds are as many as the longest chain. Beyond ``rounds`` an error is raised.
    """
    session.ensure_checkpoint_dir(blocks.sparkSession)
    here = [key, "first_line"]
    defs, uses = definitions_and_uses(blocks, key)
    uses = uses.checkpoint()
    into = defs.select(*here, "n", "var", "checked")
    edges = uses.where("by is not null and def is not null").select(*here, F.col("var").alias("from_var"), F.col("def").alias("from_n"), F.col("by").alias("var"), "n").join(session.shuffled(into), [*here, "n", "var"]).distinct().checkpoint()
    known = defs.select(*here, "n", "var", "checked", F.explode("source").alias("source")).select(*here, "n", "var", "source", "checked").distinct().checkpoint()
    new = known
    for _ in range(rounds):
        step = new.select(*here, F.col("n").alias("from_n"), F.col("var").alias("from_var"), "source", F.col("checked").alias("was")).join(session.shuffled(edges), [*here, "from_n", "from_var"])
        step = step.select(*here, "n", "var", "source", (F.col("was") | F.col("checked")).alias("checked")).distinct()
        new = step.join(session.shuffled(known), [*here, "n", "var", "source", "checked"], "left_anti").checkpoint()
        if new.isEmpty():
            break
        known = known.unionByName(new).checkpoint()
    else:
        raise RuntimeError(f"values pass through more than {rounds} definitions")
    named = lambda patterns: F.explode(F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(name)) for name, p in patterns.items()])))
    at = uses.where("def is not null").select(*here, "n", "var", F.col("def"), named(SINKS).alias("sink")).distinct()
    states = known.select(*here, F.col("n").alias("def"), "var", "source", "checked")
    flowed = at.join(session.shuffled(states), [*here, "def", "var"]).groupBy(*here, "n", "sink", F.col("var").alias("variable"), "source").agg(F.bool_and("checked").alias("checked"))
    plain = statements(blocks, key).select(*here, "n", "text", named(SINKS).alias("sink")).select(*here, "n", "sink", named(SOURCES).alias("source"))
    found = flowed.unionByName(plain.select(*here, "n", "sink", F.col("source").alias("variable"), "source", F.lit(False).alias("checked")))
    critical, high = F.col("source").isin(*CRITICAL), F.col("sink").isin(*HIGH)
    return found.withColumn("severity", F.when(high & critical, "critical").when(high, "high").when(critical, "medium").otherwise("low"))


# ---- intermediate code ----------------------------------------------------------------------------

#: Names that a compiler makes up for values on the way.
TEMPORARY = r"^(?:TMP|REF|TUPLE)_\d+$"
VALUE = r"([A-Za-z_][\w.]*)\((?:[^()]|\([^()]*\))*\)"


def ir_definitions(lines: DataFrame, *by: str, line: str = "line") -> DataFrame:
    """``(by..., n, defined, read, calls_out)`` of lines that define a value: ``X(type) = ...``, ``X(type) := ...``,
    ``X(type) -> ...``; ``read`` are the values on the right."""
    return lines.select(*by, "n", *_definition(line)).where("defined <> ''")


def _definition(line: str) -> list[Column]:
    """Columns of ``ir_definitions``; ``defined`` is empty where a line defines nothing."""
    left = F.regexp_extract(line, rf"^\s*{VALUE}\s*(?::?=(?!=)|->)", 1)
    right = F.regexp_extract(line, rf"^\s*{VALUE}\s*(?::?=(?!=)|->)\s*(.*)$", 2)
    read = F.array_distinct(F.regexp_extract_all(right, F.lit(VALUE), F.lit(1)))
    inner = F.regexp_extract_all(right, F.lit(r"([A-Za-z_]\w*)\s*\["), F.lit(1))
    out = right.rlike(r"\b(?:HIGH_LEVEL_CALL|LOW_LEVEL_CALL|SEND|TRANSFER)\b")
    return [left.alias("defined"), F.array_distinct(F.concat(read, inner)).alias("read"), out.alias("calls_out")]


@lru_cache(1 << 14)
def _temporary(name: str) -> bool:
    return re.match(TEMPORARY, name) is not None


def origins_of(name: str, reads: dict[str, set[str]], known: dict[str, set[str]]) -> set[str]:
    """What the temporary ``name`` stands for in the end, by what values are made of; temporaries that nothing defines stay as
    they are, circles add nothing. ``known`` keeps what was found."""
    if name not in known:
        seen, ahead, found = {name}, [name], set()
        while ahead:
            for x in reads.get(ahead.pop(), ()):
                if x in seen:
                    continue
                seen.add(x)
                if x in known:
                    found |= known[x]
                elif x in reads and _temporary(x):
                    ahead.append(x)
                else:
                    found.add(x)
        known[name] = found
    return known[name]


def writes_of(rows: list[tuple]) -> list[tuple[str, list[str], bool]]:
    """``(variable, depends_on, after_call)`` of the lines ``(n, defined, read, calls, stores)`` of one function: what is written
    to names other than temporaries, and to what references point at."""
    reads, at, known, found = {}, {}, {}, {}
    for n, defined, read, *_ in rows:
        if defined:
            at.setdefault((n, defined), set()).update(read)
            if others := [r for r in read if r != defined]:
                reads.setdefault(defined, set()).update(others)
    call = min((n for n, _, _, calls, _ in rows if calls and n is not None), default=None)
    for n, defined, _, _, stores in rows:
        if not defined or n is None or not stores and _temporary(defined):
            continue
        made = set()
        for r in at[n, defined]:
            made |= (origins_of(r, reads, known) or {r}) if _temporary(r) else {r}
        for variable in origins_of(defined, reads, known) if stores else (defined,):
            depends, after = found.get(variable, (set(), False))
            found[variable] = depends | made, after or (call is not None and call < n)
    return [(v, sorted(depends), after) for v, (depends, after) in found.items() if not _temporary(v)]


def transitions(lines: DataFrame, state: DataFrame, *by: str, most: int = 100_000) -> DataFrame:
    """``(by..., variable, depends_on, after_call)``: the state variables that a function of intermediate code writes, the
    state variables and inputs that their new values come from, and whether a call out stands before a write.
    ``state(variable)`` lists the state variables, none of which has a temporary's name; writes to what a reference points at
    are writes of its variable.

    Lines are read once and a function's lines are brought together once (by a window, which takes them as they lie where they
    are together already); sorted partitions are then read function by function, and only one function's lines are held.
    """
    session.ensure_checkpoint_dir(lines.sparkSession)
    stores, calling = F.col("line").rlike(r"^\s*REF_\d+\([^()]*\)\s*:="), F.col("line").rlike(r"^\s*(?:HIGH_LEVEL_CALL|LOW_LEVEL_CALL|SEND|TRANSFER)\b")
    parsed = lines.select(*by, "n", *_definition("line"), stores.alias("stores"), calling.alias("calling")).where(" and ".join(f"`{b}` is not null" for b in by))
    told = parsed.where("defined <> '' or calling").select(*by, "n", "defined", F.array_join("read", " ").alias("read"), F.expr("(defined <> '' and calls_out) or calling").alias("calls"), "stores")
    together = told.withColumn("size__", F.count("*").over(Window.partitionBy(*by)))
    schema = T.StructType([*lines.select(*by).schema, *T.StructType.fromDDL("variable string, depends_on array<string>, after_call boolean")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            batch = pa.concat_batches([left, batch]) if left else batch
            n, defined, read, calls, stores, sizes = (batch.column(i).to_pylist() for i in range(len(by), batch.num_columns))
            begin, rows, first = 0, [], []
            while begin < len(n) and (end := begin + sizes[begin]) <= len(n):
                own = [(n[i], defined[i], read[i].split(), calls[i], stores[i]) for i in range(begin, end)]
                found = writes_of(own)
                rows += found
                first += [begin] * len(found)
                begin = end
            left = batch.slice(begin)
            if rows:
                keys = [batch.column(i).take(pa.array(first)) for i in range(len(by))]
                yield pa.record_batch([*keys, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.list_(pa.string()), pa.bool_()), strict=True))], schema.names)

    names = state.select("variable").distinct()
    names = F.broadcast(names) if names.count() <= most else names  # writes to one variable would meet in one task
    return together.mapInArrow(run, schema).join(names, "variable", "left_semi").select(schema.names).checkpoint()
