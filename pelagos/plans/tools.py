"""Queries that read captured outputs of tools: one output per finding of the events, in each tool's own shape.

Bodies are written by SQL that reads alike in Spark and in the comparison, and are parsed there by its JSON functions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pelagos.plans import views
from pelagos.plans.registry import query
from pelagos.sources import tools as T

EMPTY = "NULL"
NL = "chr(10)"


def _column(name: str, value: str) -> str:
    kind = {"string": "VARCHAR", "double": "DOUBLE", "int": "INT"}[T.COLUMNS[name]]
    return f"CAST({value} AS {kind}) AS {name}"


def shape_query(name: str, shape: str, body: str, rows: str, **fields: str) -> None:
    """Register the reading of ``shape`` over bodies made by ``body``. ``rows`` is SQL that gives (ord, contract, idx, x) of
    ``o(ord, contract, body)``; ``fields`` is SQL over x."""
    columns = ", ".join(_column(c, fields.get(c, EMPTY)) for c in T.COLUMNS)
    sql = f"o AS (SELECT ord, file AS contract, {body} AS body FROM findings), r AS ({rows}) SELECT ord, idx::INT AS idx, {columns} FROM r"

    @query(name, sql)
    def run(spark, sf):
        outputs = views.findings(spark, sf).select("ord", F.col("file").alias("contract"), F.expr(body).alias("body"))
        return T.normalize(outputs, shape)


def json_rows(path: str) -> str:
    return f"SELECT ord, contract, unnest(range(len(l))) AS idx, unnest(l) AS x FROM (SELECT ord, contract, json_extract(body, '{path}') AS l FROM o)"


def line_rows(where: str) -> str:
    numbered = "SELECT ord, contract, body, unnest(range(len(l))) AS n, unnest(l) AS x FROM (SELECT ord, contract, body, string_split(body, chr(10)) AS l FROM o)"
    return f"SELECT ord, contract, body, n, row_number() OVER (PARTITION BY ord ORDER BY n) - 1 AS idx, x FROM ({numbered}) WHERE {where}"


def at(path: str) -> str:
    return f"json_extract_string(x, '$.{path}')"


DETECTOR = """'{"results":{"detectors":[{"check":"' || type || '","impact":"' || CASE severity WHEN 'Critical' THEN 'High' WHEN 'Info' THEN 'Informational' ELSE severity END || '","confidence":"' || CASE WHEN ord % 3 = 0 THEN 'High' ELSE 'Odd' END || '","description":"' || message || chr(92) || 'nmore","elements":[{"name":"' || function || '","source_mapping":{"filename_short":"' || file || '","lines":[' || line || ',' || (line + 1) || ']}}]},{"check":"locked-ether","impact":"None","elements":[]}]}}'"""
shape_query(
    "s19_detector_outputs", "detectors", DETECTOR, json_rows("$.results.detectors[*]"),
    type=f"coalesce({at('check')}, 'unknown')", severity=T.equal(f"coalesce({at('impact')}, 'Low')", T.DETECTOR_SEVERITY, "Low"),
    confidence=T.equal(f"coalesce({at('confidence')}, 'Medium')", T.DETECTOR_CONFIDENCE, 0.75), file=f"coalesce({at('elements[0].source_mapping.filename_short')}, 'unknown')",
    line=f"coalesce({at('elements[0].source_mapping.lines[0]')}::INT, 0)", function=f"coalesce({at('elements[0].name')}, 'unknown')",
    message=f"CASE WHEN coalesce({at('description')}, '') = '' THEN {at('check')} ELSE split_part({at('description')}, chr(10), 1) END", swc_id=T.contained(at("check"), T.DETECTOR_SWC),
)

GROUPS = """'{"high_issues":{"issues":[{"detector_name":"' || type || '","title":"T ' || type || '","instances":[{"contract_path":"' || file || '","line_no":' || line || '},{"contract_path":"' || file || '","line_no":' || (line + 5) || '}]}]}' || CASE WHEN ord % 2 = 0 THEN ',"low_issues":{"issues":[{"detector_name":"' || function || '","instances":[{"line_no":7}]}]}' ELSE '' END || '}'"""
shape_query(
    "s20_issue_group_outputs", "issue groups", GROUPS,
    """SELECT ord, contract, row_number() OVER (PARTITION BY ord ORDER BY s, n) - 1 AS idx, s, i, x FROM (
       SELECT ord, contract, 'High' AS s, unnest(json_extract(body, '$.high_issues.issues[*].instances[*]')) AS x, unnest([0, 1]) AS n, json_extract(body, '$.high_issues.issues[0]') AS i FROM o
       UNION ALL SELECT ord, contract, 'Low', unnest(json_extract(body, '$.low_issues.issues[*].instances[*]')), 2, json_extract(body, '$.low_issues.issues[0]') FROM o)""",
    type="json_extract_string(i, '$.detector_name')", severity="s", file=f"coalesce({at('contract_path')}, 'unknown')", line=at("line_no"), function="'unknown'",
    message="coalesce(json_extract_string(i, '$.title'), 'Unknown issue')",
)

SYMBOLIC = """'{"issues":[{"swc-id":"' || CASE WHEN ord % 4 = 0 THEN '' ELSE CAST(100 + ord % 30 AS VARCHAR(3)) END || '","severity":"' || severity || '","title":"' || type || '","function":"' || function || '","locations":[{"filename":"' || file || '","sourceMap":"' || line || ':20:0"}]},{"title":"bare"}]}'"""
shape_query(
    "s31_symbolic_issue_outputs", "symbolic issues", SYMBOLIC, json_rows("$.issues[*]"),
    type=f"coalesce({at('title')}, 'Unknown Issue')", severity=f"CASE WHEN {at('severity')} IN ('High', 'Medium', 'Low') THEN {at('severity')} ELSE 'Medium' END", confidence="0.85",
    file=f"coalesce({at('locations[0].filename')}, 'unknown')", line=f"coalesce(split_part({at('locations[0].sourceMap')}, ':', 1)::INT, 0)",
    function=f"coalesce({at('function')}, 'unknown')", message=f"coalesce({at('title')}, 'Unknown Issue')", swc_id=f"CASE WHEN {at('swc-id')} <> '' THEN 'SWC-' || {at('swc-id')} END",
)

LINT = """'[{"ruleId":"' || CASE WHEN ord % 2 = 0 THEN 'reentrancy' ELSE 'quotes' END || '","severity":"' || CASE WHEN ord % 3 = 0 THEN 'error' ELSE 'odd' END || '","message":"' || message || '","filePath":"' || file || '","line":' || line || '},{"ruleId":"no-inline-assembly"}]'"""
shape_query(
    "s21_lint_outputs", "lint", LINT, json_rows("$[*]"),
    type=f"CASE WHEN {at('ruleId')} IN {T.LINT_SECURITY} THEN 'security_issue' ELSE 'style_violation' END", severity=T.equal(f"coalesce({at('severity')}, 'warning')", T.LINT_SEVERITY, "medium"),
    file=f"coalesce({at('filePath')}, '')", line=at("line"), message=f"coalesce({at('message')}, 'Linting violation')",
)

LINT_TEXT = f"""'summary' || {NL} || file || ':' || line || ':4: [' || CASE WHEN ord % 3 = 0 THEN 'error' ELSE 'warning' END || '] ' || type || ' found (' || CASE WHEN ord % 2 = 0 THEN 'not-rely-on-time' ELSE 'indent' END || ')' || {NL} || 'no match: 3'"""
shape_query(
    "s21_lint_line_outputs", "lint lines", LINT_TEXT, line_rows("contains(x, ': [')"),
    type="CASE WHEN contains(x, 'not-rely-on-time') THEN 'security_issue' ELSE 'style_violation' END", severity="CASE WHEN contains(x, '[error]') THEN 'high' ELSE 'medium' END",
    file="split_part(x, ':', 1)", line="split_part(x, ':', 2)", message="split_part(split_part(x, '] ', 2), ' (', 1)",
)

PATTERN = """'{"results":[{"check_id":"rules.' || type || '","path":"' || file || '","start":{"line":' || line || ',"col":2},"extra":{"severity":"' || CASE WHEN ord % 2 = 0 THEN 'ERROR' ELSE 'INFO' END || '","message":"' || message || '"}},{"check_id":"block-price"}]}'"""
shape_query(
    "s23_pattern_result_outputs", "pattern results", PATTERN, json_rows("$.results[*]"),
    type=T.contained(at("check_id"), T.PATTERN_TYPE, "security_issue"), severity=T.equal(f"coalesce({at('extra.severity')}, 'WARNING')", T.PATTERN_SEVERITY, "medium"),
    file=f"coalesce({at('path')}, '')", line=at("start.line"), message=f"coalesce({at('extra.message')}, 'Security issue detected')",
)

GRADED = """'[{"title":"' || type || '","severity":"' || CASE ord % 4 WHEN 0 THEN 'H' WHEN 1 THEN 'NC' WHEN 2 THEN 'M' ELSE 'odd' END || '","file":"' || file || '","line":' || line || ',"swc_id":"SWC-' || (100 + ord % 30) || '"},{}]'"""
shape_query(
    "s24_graded_issue_outputs", "graded issues", GRADED, json_rows("$[*]"),
    type=f"coalesce({at('title')}, 'unknown')", severity=T.equal(f"coalesce({at('severity')}, 'L')", T.GRADE_SEVERITY, "Low"), confidence="0.7", file=f"coalesce({at('file')}, '')",
    line=f"coalesce({at('line')}::INT, 0)", function="''", message="''", swc_id=at("swc_id"),
)

TESTS = """'{"test_results":{"' || file || '":{"test_' || function || '":{"success":' || CASE WHEN ord % 3 = 0 THEN 'true' ELSE 'false' END || ',"reason":"' || type || '"},"test_x":{"success":false}}}}'"""
shape_query(
    "s27_test_result_outputs", "test results", TESTS,
    """SELECT ord, contract, row_number() OVER (PARTITION BY ord ORDER BY n) - 1 AS idx, k, x FROM (
       SELECT ord, contract, unnest(range(len(keys))) AS n, unnest(keys) AS k, unnest([json_extract(m, '$.' || q) FOR q IN keys]) AS x
       FROM (SELECT ord, contract, m, json_keys(m) AS keys FROM (SELECT ord, contract, json_extract(body, '$.test_results."' || contract || '"') AS m FROM o))) WHERE json_extract_string(x, '$.success') = 'false'""",
    type="'test_failure'", severity="'high'", file="contract", function="k", message=f"'Test ' || k || ' failed: ' || coalesce({at('reason')}, 'Test failed')",
)

PROPERTY = f"""'Analyzing' || {NL} || 'echo_' || function || ': ' || CASE WHEN ord % 2 = 0 THEN 'failed!' ELSE 'passing' END || {NL} || '  1. f(' || line || ')' || {NL} || CASE WHEN ord % 5 = 0 THEN 'Assertion in ' || type || ' failed' ELSE 'done' END"""
shape_query(
    "s25_property_line_outputs", "property lines", PROPERTY, line_rows("contains(lower(x), 'failed')"),
    type="CASE WHEN contains(x, ':') THEN 'property_violation' ELSE 'assertion_failure' END", severity="CASE WHEN contains(x, ':') THEN 'high' ELSE 'critical' END",
    function="CASE WHEN contains(x, ':') THEN split_part(x, ':', 1) END", message="CASE WHEN contains(x, ':') THEN 'Property ' || split_part(x, ':', 1) || ' violated during fuzzing' ELSE x END",
)

FUZZ = f"""'start' || {NL} || '[FAIL] ' || CASE ord % 4 WHEN 0 THEN 'assertion' WHEN 1 THEN 'reentrancy' WHEN 2 THEN 'underflow' ELSE 'strange' END || ' in ' || function || {NL} || 'call sequence' || {NL} || CASE WHEN ord % 2 = 0 THEN 'at ' || file || ':' || line || ':5' ELSE 'nowhere' END"""
shape_query(
    "s26_fuzz_line_outputs", "fuzz lines", FUZZ, line_rows("contains(x, '[FAIL]')"),
    type=T.contained("x", T.FUZZ_TYPE, "unknown_violation"), severity="CASE WHEN contains(x, 'reentrancy') THEN 'Critical' WHEN contains(x, 'strange') THEN 'Medium' ELSE 'High' END", confidence="0.85",
    file="CASE WHEN contains(body, '.sol:') THEN contract ELSE 'unknown' END", line="CASE WHEN contains(body, '.sol:') THEN split_part(split_part(body, '.sol:', 2), ':', 1)::INT ELSE 0 END", function="'unknown'", message="x",
    swc_id=T.equal(f"({T.contained('x', T.FUZZ_TYPE, 'unknown_violation')})", T.FUZZ_SWC),
)

PROVER = f"""'Verifying' || {NL} || 'Rule ' || function || ' violated' || {NL} || CASE WHEN ord % 3 = 0 THEN 'a violation without a name' ELSE 'all else holds' END"""
shape_query(
    "s36_prover_line_outputs", "prover lines", PROVER, line_rows("contains(x, 'violat')"),
    type="'rule_violation'", severity="'CRITICAL'", confidence="0.98", file="contract", function="CASE WHEN contains(x, 'Rule') THEN split_part(x, ' ', 2) ELSE 'unknown_rule' END",
    message="'Rule Violation: ' || CASE WHEN contains(x, 'Rule') THEN split_part(x, ' ', 2) ELSE 'unknown_rule' END",
)

SYMTEST = f"""'[FAIL] test' || function || '(uint256)' || {NL} || CASE WHEN ord % 2 = 0 THEN 'Counterexample:' ELSE 'trace' END || {NL} || 'assert(false) at ' || line || {NL} || '[PASS] test_ok()'"""
shape_query(
    "s33_symbolic_test_outputs", "symbolic tests", SYMTEST, line_rows("contains(x, 'FAIL') OR contains(x, 'Counterexample') OR contains(x, 'assert(false)')"),
    type="CASE WHEN contains(x, 'assert') THEN 'assertion_violation' ELSE 'property_violation' END", severity="'HIGH'", confidence="CASE WHEN contains(x, 'assert') THEN 0.88 ELSE 0.90 END", file="contract",
    function="CASE WHEN contains(x, 'assert') THEN NULL WHEN contains(x, 'FAIL') THEN split_part(split_part(x, '] ', 2), '(', 1) ELSE 'unknown_test' END", message="x",
)

UNIT = f"""'FAILED tests/t.py::test_' || function || ' - x' || {NL} || 'E  assert' || {NL} || CASE WHEN ord % 4 = 0 THEN 'ERROR at setup' ELSE 'PASSED tests' END"""
shape_query(
    "s22_unit_test_outputs", "unit tests", UNIT, line_rows("contains(x, 'FAILED') OR contains(x, 'ERROR')"),
    type="'test_failure'", severity="CASE WHEN contains(x, 'ERROR') THEN 'HIGH' ELSE 'MEDIUM' END", confidence="0.9", file="contract",
    function="CASE WHEN contains(x, '::') THEN split_part(split_part(x, '::', 2), ' ', 1) ELSE 'unknown_test' END", message="x",
)

PATHS = f"""'Traceback REVERT' || {NL} || CASE ord % 3 WHEN 0 THEN 'INVALID instruction' WHEN 1 THEN 'Possible Overflow in ' || function ELSE 'External call before write' END || {NL} || 'ok'"""
shape_query(
    "s32_path_line_outputs", "path lines", PATHS, line_rows("n = 1"),
    type="CASE WHEN contains(x, 'INVALID') THEN 'assertion_failure' WHEN contains(x, 'Overflow') THEN 'integer_overflow' ELSE 'reentrancy' END",
    severity="CASE WHEN contains(x, 'External') THEN 'CRITICAL' ELSE 'HIGH' END", confidence="CASE WHEN contains(x, 'INVALID') THEN 0.85 WHEN contains(x, 'Overflow') THEN 0.80 ELSE 0.75 END", file="contract", message="x",
)

CHECKER = f"""file || ':' || line || ':9: Warning: CHC: ' || CASE ord % 4 WHEN 0 THEN 'Overflow happens here' WHEN 1 THEN 'Division by zero happens here' WHEN 2 THEN 'Condition is trivial' ELSE 'Something' END || {NL} || '  note' || {NL} || CASE WHEN ord % 5 = 0 THEN 'Error: Assertion verified' ELSE '' END"""
shape_query(
    "s37_checker_line_outputs", "checker lines", CHECKER, line_rows("contains(x, 'Warning:') OR contains(x, 'Error:')"),
    type="CASE WHEN contains(x, 'Overflow') THEN 'arithmetic_overflow' WHEN contains(x, 'Division') THEN 'division_by_zero' WHEN contains(x, 'trivial') THEN 'trivial_condition' WHEN contains(x, 'Assertion') THEN 'assertion_violation' ELSE 'smt_checker_warning' END",
    severity="CASE WHEN contains(x, 'Error:') THEN 'HIGH' ELSE 'MEDIUM' END",
    confidence="CASE WHEN contains(x, 'verified') THEN 0.95 WHEN contains(x, 'Overflow') OR contains(x, 'Division') THEN 0.90 WHEN contains(x, 'trivial') THEN 0.75 ELSE 0.80 END",
    file="contract", line="CASE WHEN contains(x, '.sol:') THEN split_part(x, ':', 2)::INT END", message="CASE WHEN contains(x, 'Error: ') THEN split_part(x, 'Error: ', 2) ELSE split_part(x, 'Warning: ', 2) END",
)

COMPILER = f"""'Compiled 3 files' || {NL} || file || ':' || line || ':1: ' || CASE WHEN ord % 2 = 0 THEN 'Warning' ELSE 'Error' END || ': ' || CASE ord % 3 WHEN 0 THEN 'Unused variable x' WHEN 1 THEN 'Unreachable code.' ELSE 'Undeclared' END"""
shape_query(
    "s30_compiler_line_outputs", "compiler lines", COMPILER, line_rows("contains(x, '.sol:')"),
    type="CASE WHEN contains(x, 'Unused') THEN 'unused_variable' WHEN contains(x, 'Unreachable') THEN 'unreachable_code' ELSE 'compilation_warning' END",
    severity="CASE WHEN NOT contains(x, 'Undeclared') THEN 'low' WHEN contains(x, 'Warning') THEN 'medium' ELSE 'high' END", file="contract", line="split_part(x, ':', 2)", message="split_part(x, ': ', 3)",
)

TYPED = """'{"vulnerabilities":[{"type":"' || CASE ord % 3 WHEN 0 THEN 'Integer Overflow' WHEN 1 THEN 'callstack' ELSE type END || '","line":' || line || ',"function":"' || function || '"},{"message":"m"}]}'"""
_TYPED = f"replace(lower(coalesce({at('type')}, 'unknown')), ' ', '_')"
shape_query(
    "s34_typed_list_outputs", "typed list", TYPED, json_rows("$.vulnerabilities[*]"),
    type=_TYPED, severity=T.equal(_TYPED, T.TYPED_KIND, "Medium", 0), confidence=T.equal(_TYPED, T.TYPED_KIND, 0.60, 1), file="contract", line=f"coalesce({at('line')}::INT, 0)",
    function=f"coalesce({at('function')}, '')", message=f"coalesce({at('message')}, {_TYPED})", swc_id=T.equal(_TYPED, T.TYPED_KIND, None, 2),
)

ANSWER = f"""CASE WHEN ord % 3 = 0 THEN 'no object: Reentrancy in ' || function || {NL} || 'nothing' ELSE 'Here it is:' || {NL} || '{{"vulnerabilities": [{{"type": "' || type || '", "severity": "' || severity || '", "line": ' || line || ', "description": "' || message || '"}}, {{"function": "g"}}]}}' || {NL} || 'done' END"""
shape_query(
    "s41_answer_outputs", "answer", ANSWER,
    """SELECT ord, contract, idx, x FROM (""" + json_rows("$.vulnerabilities[*]").replace("json_extract(body, ", "json_extract(split_part(body, chr(10), 2), ").replace("FROM o)", "FROM o WHERE ord % 3 <> 0)") + """)
       UNION ALL SELECT ord, contract, 0, json_object('type', 'reentrancy', 'severity', 'CRITICAL', 'confidence', 0.7, 'description', split_part(body, chr(10), 1)) FROM o WHERE ord % 3 = 0""",
    type=f"coalesce({at('type')}, 'ai_detected_pattern')", severity=f"upper(coalesce({at('severity')}, 'MEDIUM'))", confidence=f"coalesce({at('confidence')}::DOUBLE, 0.75)", file="contract",
    line=f"coalesce({at('line')}::INT, 0)", function=f"coalesce({at('function')}, '')", message=f"coalesce({at('description')}, '')",
)

FINDINGS = """'{"findings":[{"category":"' || type || '","severity":"' || severity || '","confidence":0.5,"description":"' || message || '","location":{"file":"' || file || '","line":"' || line || '","function":"' || function || '"}},{"title":"t"}]}'"""
_FINDINGS = dict(
    type=f"coalesce({at('type')}, {at('category')}, {at('title')})", severity=at("severity"), confidence=at("confidence"), file=f"coalesce({at('location.file')}, contract)", line=at("location.line"),
    function=at("location.function"), message=f"coalesce({at('message')}, {at('description')}, {at('title')})",
)
shape_query("s48_finding_outputs", "findings", FINDINGS, json_rows("$.findings[*]"), **_FINDINGS)

MANY = ("dagnn", "mev_detector", "cairo", "unheard-of")


@query(
    "s13_outputs_of_many_tools",
    f"o AS (SELECT ord, ['{"', '".join((*MANY, 'slither'))}'][ord % 5 + 1] AS tool, CASE WHEN ord % 5 = 4 THEN {DETECTOR} ELSE {FINDINGS} END AS body FROM findings) "
    "SELECT tool, count(*) AS outputs, sum(len(json_extract(body, '$.findings[*]')) + len(json_extract(body, '$.results.detectors[*]')))::BIGINT AS findings FROM o GROUP BY tool",
)
def s13(spark, sf):
    """Outputs of five tools in one table, read by shape."""
    named = F.get(F.array(*map(F.lit, (*MANY, "slither"))), (F.col("ord") % 5).cast("int"))
    body = F.when(F.col("ord") % 5 == 4, F.expr(DETECTOR)).otherwise(F.expr(FINDINGS))
    outputs = views.findings(spark, sf).select("ord", named.alias("tool"), F.col("file").alias("contract"), body.alias("body"))
    found = T.collect(outputs).groupBy("tool").agg(F.count("*").alias("findings"))
    return outputs.groupBy("tool").agg(F.count("*").alias("outputs")).join(found, "tool")
