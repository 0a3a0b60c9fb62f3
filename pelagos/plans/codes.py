"""Queries over source code: rules with scopes, functions, calls, versions, imports, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagos import session
from pelagos.operators import code, lexer
from pelagos.plans import views
from pelagos.plans.registry import query

_RULES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in code.CODE_RULES)
_HITS = f"""rules(rule, pattern, guard, scope, category, severity) AS (VALUES {_RULES}),
guards AS (SELECT doc_id, n, block, rule FROM code_lines, rules WHERE guard IS NOT NULL AND regexp_matches(line, guard)),
found AS (SELECT doc_id, n, block, rule, scope, category, severity FROM code_lines, rules WHERE regexp_matches(line, pattern)),
hits AS (SELECT f.doc_id, f.n AS line_no, f.rule, f.category, f.severity FROM found f ANTI JOIN guards g ON f.doc_id = g.doc_id AND f.rule = g.rule
  AND CASE f.scope WHEN 'file' THEN true WHEN 'function' THEN f.block = g.block ELSE abs(f.n - g.n) <= 3 END)"""


def _hits(spark, sf):
    return code.detect(views.contracts(spark, sf))


def _blocks(spark, sf):
    docs = views.contracts(spark, sf)
    return lexer.functions(docs).join(session.shuffled(docs.select("doc_id", "repo")), "doc_id")


@query("t18_scoped_rules", f"{_HITS} SELECT * FROM hits")
def t18(spark, sf):
    """Rule hits that nothing in the line's window, function or file makes harmless."""
    return _hits(spark, sf)


@query("t20_first_per_category", f"{_HITS} SELECT doc_id, category, line_no, rule, severity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY line_no, rule) AS place FROM hits) WHERE place = 1")
def t20(spark, sf):
    return code.first_per_category(_hits(spark, sf))


@query("a36_rule_summary", f"{_HITS} SELECT category, severity, count(*) AS hits, count(DISTINCT doc_id) AS documents, min(line_no) AS first_line FROM hits GROUP BY category, severity")
def a36(spark, sf):
    return code.hit_summary(_hits(spark, sf))


_INDICATORS, _ANTI = [r"getReserves\(", r"\.call\{value", r"twap"], [r"onlyOwner", r"nonReentrant"]
_OCCURRENCES = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in _INDICATORS)
_AGAINST = " + ".join(f"regexp_matches(text, '{p}')::INT" for p in _ANTI)


@query("t19_indicator_scores", f"SELECT doc_id, found::INT AS found, round_even(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.7::DOUBLE * found / 3 - least(0.4::DOUBLE, 0.1::DOUBLE * against) + 0.05::DOUBLE + 0.2::DOUBLE)), 6) AS confidence FROM (SELECT doc_id, {_OCCURRENCES} AS found, {_AGAINST} AS against FROM contracts) WHERE found > 0")
def t19(spark, sf):
    return code.indicator_score(views.contracts(spark, sf), _INDICATORS, _ANTI, 0.05)


@query("t26_advised_imports", "SELECT c.doc_id, '@lib/pack' || doc_id % 3 || '/token.sol' AS path, 'A-' || doc_id % 3 AS advisory FROM contracts c WHERE doc_id % 3 < 2")
def t26(spark, sf):
    advisories = spark.createDataFrame([("@lib/pack0", "A-0"), ("@lib/pack1", "A-1"), ("@lib/other", "A-9")], "package string, advisory string")
    return code.imports(views.contracts(spark, sf), advisories)


@query("t28_traits", "SELECT doc_id, bool_or(false) AS vault, bool_or(false) AS token, bool_or(contains(line, 'getReserves(')) AS spot_price, bool_or(contains(line, 'nonReentrant')) AS guarded FROM code_lines GROUP BY doc_id")
def t28(spark, sf):
    return code.traits(views.contracts(spark, sf))


@query("t10_code_without_comments", "SELECT doc_id, md5(kept) AS digest, len(string_split(kept, chr(10))) AS n_lines FROM masked")
def t10(spark, sf):
    plain = code.without_comments(F.col("text"))
    return views.contracts(spark, sf).select("doc_id", F.md5(plain).alias("digest"), F.size(F.split(plain, "\n")).cast("long").alias("n_lines"))


@query("t11_functions", "SELECT doc_id, name, first_line::INT AS first_line, last_line::INT AS last_line FROM blocks")
def t11(spark, sf):
    return lexer.functions(views.contracts(spark, sf)).select("doc_id", "name", "first_line", "last_line")


@query("t12_compiler_versions", "SELECT doc_id, ((4 + doc_id % 5) * 1000 + doc_id % 20)::INT AS version FROM contracts")
def t12(spark, sf):
    return views.contracts(spark, sf).select("doc_id", code.pragma(F.col("text")).alias("version"))


_KEYWORDS = "[" + ", ".join(f"'{k}'" for k in code.KEYWORDS) + "]"


@query("t3_token_classes", f"""t AS (SELECT doc_id, regexp_extract_all(string_agg(line, chr(10) ORDER BY n), '{code.TOKEN}') AS t FROM code_lines GROUP BY doc_id)
SELECT doc_id, len(t)::INT AS tokens, len(list_filter(t, lambda x: list_contains({_KEYWORDS}, x)))::INT AS keywords,
 len(list_filter(t, lambda x: regexp_matches(x, '^[A-Za-z_$]') AND NOT list_contains({_KEYWORDS}, x)))::INT AS identifiers, len(list_filter(t, lambda x: regexp_matches(x, '^[0-9]')))::INT AS numbers,
 len(list_filter(t, lambda x: regexp_matches(x, '^[-+*/%=<>!&|^~]')))::INT AS operators, len(list_distinct([t[i] || ' ' || t[i + 1] FOR i IN range(1, len(t))]))::INT AS different_runs FROM t""")
def t3(spark, sf):
    return code.token_classes(views.contracts(spark, sf))


_CALLS = f"""calls AS (SELECT DISTINCT repo, doc_id, name AS src, unnest(regexp_extract_all(body, '{code.CALL}', 1)) AS dst FROM blocks)"""


@query("g1_calls", f"{_CALLS} SELECT c.doc_id, c.src, c.dst FROM calls c SEMI JOIN blocks b ON c.doc_id = b.doc_id AND c.dst = b.name")
def g1(spark, sf):
    return code.calls(_blocks(spark, sf))


@query("g7_repository_calls", f"""{_CALLS}, own AS (SELECT c.*, c.doc_id AS dst_doc FROM calls c SEMI JOIN blocks b ON c.doc_id = b.doc_id AND c.dst = b.name),
other AS (SELECT c.*, b.doc_id AS dst_doc FROM (SELECT c.* FROM calls c ANTI JOIN blocks b ON c.doc_id = b.doc_id AND c.dst = b.name) c JOIN blocks b ON c.repo = b.repo AND c.dst = b.name)
SELECT DISTINCT repo, doc_id AS src_doc, src, dst_doc, dst FROM (SELECT * FROM own UNION ALL SELECT * FROM other)""")
def g7(spark, sf):
    """Calls within a repository, across its documents where the own one has no such function."""
    return code.repo_calls(_blocks(spark, sf), "repo")


_FLAGS = r"""flags AS (SELECT doc_id, name, CASE WHEN regexp_matches(head, '\b(external|public)\b') THEN 'open' ELSE 'closed' END AS visibility, regexp_matches(head, 'only|nonReentrant') AS guarded,
 regexp_matches(body, '\.(call|send|transfer|delegatecall)\b') AS calls_out, regexp_matches(body, '\.(call|send)\b(.|\n)*balances\[') AS writes_after FROM blocks)"""


@query("f10_effects_after_calls", f"{_FLAGS} SELECT doc_id, name FROM flags WHERE visibility = 'open' AND NOT guarded AND calls_out AND writes_after")
def f10(spark, sf):
    """Open functions without a guard that write state after a call out."""
    return code.unsafe_order(_blocks(spark, sf))


@query("a43_call_graph_summary", f"""{_CALLS}, {_FLAGS}, e AS (SELECT c.doc_id, count(*) AS edges FROM calls c SEMI JOIN blocks b ON c.doc_id = b.doc_id AND c.dst = b.name GROUP BY c.doc_id)
SELECT f.doc_id, count(*) AS functions, count(*) FILTER (WHERE visibility = 'open') AS open, count(*) FILTER (WHERE guarded) AS guarded, count(*) FILTER (WHERE calls_out) AS calls_out, coalesce(any_value(edges), 0)::BIGINT AS edges FROM flags f LEFT JOIN e ON f.doc_id = e.doc_id GROUP BY f.doc_id""")
def a43(spark, sf):
    blocks = _blocks(spark, sf)
    return code.graph_summary(blocks, code.calls(blocks))


_IR = "CASE event_id % 4 WHEN 0 THEN 'HIGH_LEVEL_CALL, dest:TMP_' || user_id || '(T), function:transfer, arguments:[x]' WHEN 1 THEN 'total(uint256) := total(uint256) + x(uint256)' WHEN 2 THEN 'x(uint256) := owner(address)' ELSE 'RETURN x' END"


@query("p30_ir_calls", f"SELECT event_id, 'HIGH_LEVEL_CALL' AS kind, 'TMP_' || user_id AS destination, 'transfer' AS target FROM (SELECT event_id, user_id, {_IR} AS line FROM events) WHERE line LIKE 'HIGH%'")
def p30_calls(spark, sf):
    lines = views.table(spark, sf, "events").select("event_id", F.expr(_IR).alias("line"))
    return code.ir_calls(lines).select("event_id", "kind", "destination", "target")


@query("p30_ir_state_uses", f"SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'total' END AS written, CASE event_id % 4 WHEN 1 THEN 'total' ELSE 'owner' END AS read FROM (SELECT event_id, {_IR} AS line FROM events) WHERE event_id % 4 IN (1, 2)")
def p30_state(spark, sf):
    lines = views.table(spark, sf, "events").select("event_id", F.expr(_IR).alias("line"))
    return code.state_uses(lines, ("total", "owner")).select("event_id", "written", F.array_join("read", ",").alias("read"))
