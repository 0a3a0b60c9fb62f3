"""Queries over flows in source text: taint by statements, rules across functions, intermediate code."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pelagos import session
from pelagos.operators import bounded, code, crossing, embed, flows, lexer, vindex
from pelagos.plans import views
from pelagos.plans.registry import query
from pelagos.streaming import sessions


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


_NONE = "[" + ", ".join(f"'{n}'" for n in flows.NO_NAMES) + "]"
_FOUND = lambda column, patterns: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({column}, '{_re(p)}') THEN '{n}' END" for n, p in patterns.items()) + "], lambda x: x IS NOT NULL)"
_STATEMENTS = rf"""
f AS (SELECT doc_id, first_line, name, head, regexp_replace(regexp_replace(body, '{flows.OPTIONS}', '(\1)', 'g'), '{flows.LOOP}', '\1,\2,\3', 'g') AS t FROM blocks),
parts AS (SELECT doc_id, first_line, n - 1 AS n, l[n] AS text FROM (SELECT doc_id, first_line, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, first_line, string_split_regex(t, '[;{{}}]') AS l FROM f)) WHERE trim(l[n], ' ' || chr(10)) <> ''),
st AS (SELECT *, nullif(regexp_extract(text, '{flows.ASSIGNED}', 1), '') AS target, regexp_replace(text, '{flows.ASSIGNED}', ' \4') AS value, regexp_extract(text, '{flows.ASSIGNED}', 2) AS idx, regexp_extract(text, '{flows.ASSIGNED}', 3) <> '' AS compound FROM parts),
named AS (SELECT *, idx <> '' OR compound AS keeps, regexp_matches(text, '{flows.CHECK}') AND target IS NULL AS checks, list_filter(list_distinct(regexp_extract_all(value, '{flows.FREE}', 1) || regexp_extract_all(idx, '{flows.FREE}', 1)), lambda x: NOT list_contains({_NONE}, x)) AS names FROM st),
defs AS (
  SELECT doc_id, first_line, n, target AS var, false AS checked, {_FOUND("value", flows.SOURCES)} AS source FROM named WHERE target IS NOT NULL
  UNION ALL SELECT doc_id, first_line, -1, unnest(regexp_extract_all(regexp_extract(head, '^[^(]*\(([^)]*)\)', 1), '\s({flows.NAME})(?:\[\])?\s*(?:,|$)', 1)), false, ['{flows.PARAMETER}'] FROM f
  UNION ALL SELECT doc_id, first_line, n, unnest(names), true, [] FROM named WHERE checks),
used AS (SELECT doc_id, first_line, n, text, var, CASE WHEN checks THEN var ELSE target END AS by FROM (SELECT *, unnest(CASE WHEN target IS NOT NULL AND keeps THEN list_distinct(list_append(names, target)) ELSE names END) AS var FROM named)),
uses AS (SELECT u.*, (SELECT max(d.n) FROM defs d WHERE d.doc_id = u.doc_id AND d.first_line = u.first_line AND d.var = u.var AND d.n < u.n) AS def FROM used u),
edges_of AS (SELECT DISTINCT u.doc_id, u.first_line, u.var AS from_var, u.def AS from_n, d.var, d.n, d.checked FROM uses u JOIN defs d ON u.doc_id = d.doc_id AND u.first_line = d.first_line AND u.n = d.n AND u.by = d.var WHERE u.def IS NOT NULL),
known(doc_id, first_line, n, var, source, checked) AS (
  SELECT doc_id, first_line, n, var, unnest(source), checked FROM defs
  UNION SELECT k.doc_id, k.first_line, e.n, e.var, k.source, k.checked OR e.checked FROM known k JOIN edges_of e ON k.doc_id = e.doc_id AND k.first_line = e.first_line AND k.n = e.from_n AND k.var = e.from_var),
sunk AS (SELECT DISTINCT doc_id, first_line, n, var, def, unnest({_FOUND("text", flows.SINKS)}) AS sink FROM uses WHERE def IS NOT NULL),
direct AS (SELECT doc_id, first_line, n, sink, unnest({_FOUND("text", flows.SOURCES)}) AS source FROM (SELECT *, unnest({_FOUND("text", flows.SINKS)}) AS sink FROM named)),
reached AS (
  SELECT s.doc_id, s.first_line, s.n, s.sink, s.var AS variable, k.source, bool_and(k.checked) AS checked FROM sunk s JOIN known k ON s.doc_id = k.doc_id AND s.first_line = k.first_line AND s.def = k.n AND s.var = k.var GROUP BY ALL
  UNION ALL SELECT doc_id, first_line, n, sink, source, source, false FROM direct)"""
_HIGH, _CRITICAL = (", ".join(f"'{x}'" for x in xs) for xs in (flows.HIGH, flows.CRITICAL))
_GRADED = f"{_STATEMENTS}, graded AS (SELECT *, CASE WHEN sink IN ({_HIGH}) AND source IN ({_CRITICAL}) THEN 'critical' WHEN sink IN ({_HIGH}) THEN 'high' WHEN source IN ({_CRITICAL}) THEN 'medium' ELSE 'low' END AS severity FROM reached)"


def _tainted(spark, sf):
    return flows.tainted(lexer.functions(views.contracts(spark, sf)))


@query("g8_source_taint", f"{_GRADED} SELECT doc_id, first_line::INT AS first_line, n::INT AS n, sink, variable, source, checked, severity FROM graded")
def g8(spark, sf):
    """Foreign values that reach a sink, by the latest definition before each use."""
    return _tainted(spark, sf)


@query("a43_taint_summary", f"{_GRADED} SELECT sink, source, severity, count(*) AS paths, count(*) FILTER (WHERE checked) AS checked, count(DISTINCT doc_id) AS documents FROM graded GROUP BY ALL")
def a43_taint(spark, sf):
    rows = _tainted(spark, sf).groupBy("sink", "source", "severity")
    return rows.agg(F.count("*").alias("paths"), F.count_if("checked").alias("checked"), F.count_distinct("doc_id").alias("documents"))


# ---- rules across functions -----------------------------------------------------------------------

#: Contracts whose functions call each other: chains, circles, guards on the way, loops over arrays that anyone lengthens.
_WEB = " || chr(10) || ".join([
    "'contract W' || k || ' {'",
    "'  function enter(address x) public { users.push(x); step(x); }'",
    "'  function step(address x) internal ' || CASE WHEN k % 3 = 0 THEN 'onlyOwner ' ELSE '' END || '{ ' || CASE WHEN k % 2 = 0 THEN 'turn(x);' ELSE 'last(x);' END || ' }'",
    "'  function turn(address x) internal { if (x != y) { step(x); } ' || CASE WHEN k % 5 = 0 THEN 'last(x); ' ELSE '' END || '}'",
    "'  function last(address x) internal { ' || CASE k % 4 WHEN 0 THEN 'owner = x;' WHEN 1 THEN 'require(msg.sender == owner); owner = x;' WHEN 2 THEN 'x.transfer(1);' ELSE 'note(\"owner = x\");' END || ' }'",
    "'  function all() external { for (uint i = 0; i < users.length; i++) { ' || CASE WHEN k % 7 < 4 THEN 'pay(users[i]);' ELSE 'total += 1;' END || ' } }'",
    "'  function pay(address x) private { ' || CASE WHEN k % 2 = 0 THEN 'x.send(1);' ELSE 'last(x);' END || ' }'",
    "'}'",
])
_WEB_SQL = f"web AS (SELECT k AS doc_id, k, {_WEB} AS text FROM (SELECT p_partkey::BIGINT AS k FROM part))"


def _web(spark, sf):
    keys = session.spread(views.table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("k")), "k")
    return keys.select(F.col("k").alias("doc_id"), F.expr(_WEB).alias("text"))


_WEB_GRAPH = f"""{_WEB_SQL},
b AS (SELECT doc_id, regexp_extract(l, 'function (\\w+)', 1) AS name, regexp_extract(l, '^[^{{]*', 0) AS head, regexp_replace(regexp_extract(l, '\\{{(.*)\\}}', 1), '"[^"]*"', '""', 'g') AS body FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM web) WHERE contains(l, 'function')),
flag AS (SELECT doc_id, name, regexp_matches(head, '\\b(public|external)\\b') AS open, regexp_matches(head, 'only') OR contains(body, 'msg.sender ==') AS guarded, contains(body, 'owner = ') AS privileged, regexp_matches(body, '\\.(send|transfer)\\(') AS calls_out FROM b),
calls AS (SELECT DISTINCT b.doc_id, b.name AS src, c.name AS dst FROM b JOIN b c ON b.doc_id = c.doc_id AND regexp_matches(b.body, '\\b' || c.name || '\\(')),
open_calls AS (SELECT c.* FROM calls c JOIN flag f ON c.doc_id = f.doc_id AND c.dst = f.name WHERE NOT f.guarded),
reach(doc_id, src, dst) AS (SELECT * FROM calls UNION SELECT r.doc_id, r.src, c.dst FROM reach r JOIN calls c ON r.doc_id = c.doc_id AND r.dst = c.src),
open_reach(doc_id, src, dst) AS (SELECT * FROM open_calls UNION SELECT r.doc_id, r.src, c.dst FROM open_reach r JOIN open_calls c ON r.doc_id = c.doc_id AND r.dst = c.src),
out AS (SELECT doc_id, name FROM flag WHERE calls_out UNION SELECT r.doc_id, r.src FROM reach r JOIN flag f ON r.doc_id = f.doc_id AND r.dst = f.name WHERE f.calls_out),
looping AS (SELECT b.doc_id, b.name FROM b WHERE contains(body, 'for (') AND EXISTS (SELECT 1 FROM out o WHERE o.doc_id = b.doc_id AND regexp_matches(b.body, '\\b' || o.name || '\\(')))"""


@query("t18b_rules_across_functions", f"""{_WEB_GRAPH},
priv AS (SELECT f.doc_id, f.name, CASE WHEN f.privileged THEN f.name ELSE (SELECT min(c.dst) FROM open_calls c WHERE c.doc_id = f.doc_id AND c.src = f.name AND (EXISTS (SELECT 1 FROM flag g WHERE g.doc_id = c.doc_id AND g.name = c.dst AND g.privileged) OR EXISTS (SELECT 1 FROM open_reach r JOIN flag g ON r.doc_id = g.doc_id AND r.dst = g.name WHERE r.doc_id = c.doc_id AND r.src = c.dst AND g.privileged))) END AS via FROM flag f WHERE f.open AND NOT f.guarded),
looped AS (SELECT f.doc_id, f.name, CASE WHEN EXISTS (SELECT 1 FROM looping l WHERE l.doc_id = f.doc_id AND l.name = f.name) THEN f.name ELSE (SELECT min(c.dst) FROM calls c JOIN (SELECT doc_id, name FROM looping UNION SELECT r.doc_id, r.src FROM reach r JOIN looping l ON r.doc_id = l.doc_id AND r.dst = l.name) l ON c.doc_id = l.doc_id AND c.dst = l.name WHERE c.doc_id = f.doc_id AND c.src = f.name) END AS via FROM flag f WHERE f.open)
SELECT doc_id, 'open-privilege' AS rule, name, via FROM priv WHERE via IS NOT NULL UNION ALL SELECT doc_id, 'call-in-loop', name, via FROM looped WHERE via IS NOT NULL UNION ALL SELECT doc_id, 'growing-loop', 'enter', 'all' FROM web""")
def t18b(spark, sf):
    """What open functions do through the functions they call."""
    return crossing.findings(_web(spark, sf))


@query("g7_call_components", f"""{_WEB_GRAPH}, n AS (SELECT doc_id, src AS node FROM calls UNION SELECT doc_id, dst FROM calls)
SELECT n.doc_id, n.node, least(n.node, coalesce(min(r.dst), n.node)) AS component FROM n LEFT JOIN reach r ON n.doc_id = r.doc_id AND n.node = r.src AND EXISTS (SELECT 1 FROM reach b WHERE b.doc_id = r.doc_id AND b.src = r.dst AND b.dst = r.src) GROUP BY n.doc_id, n.node""")
def g7_components(spark, sf):
    """Functions that call each other in circles."""

    return crossing.components(code.calls(lexer.functions(_web(spark, sf))))


# ---- intermediate code ----------------------------------------------------------------------------

#: A function of intermediate code per order: its lines are steps of a chain of temporaries as long as the order has items.
_FUNCTIONS = "SELECT l_orderkey AS fn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, l_partkey AS p, count(*) OVER (PARTITION BY l_orderkey) AS last FROM lineitem"
_STEP = """CASE WHEN n = 1 THEN 'TMP_1(uint256) = v' || p % 5 || '(uint256) + amount(uint256)' WHEN n < last THEN CASE p % 7 WHEN 0 THEN 'TMP_' || n || '(uint256) = HIGH_LEVEL_CALL, dest:token(T), function:rate, arguments:[TMP_' || (n - 1) || '(uint256)]' ELSE 'TMP_' || n || '(uint256) = TMP_' || (n - 1) || '(uint256) c* ' || CASE WHEN p % 3 = 0 THEN 'v' || p % 4 || '(uint256)' ELSE '2(uint256)' END END
 ELSE CASE p % 3 WHEN 0 THEN 'v1(uint256) := TMP_' || (n - 1) || '(uint256)' WHEN 1 THEN 'v2(uint256) := TMP_' || (n - 1) || '(uint256)' ELSE 'RETURN TMP_' || (n - 1) END END"""


@query("p30_state_transitions", f"""i AS (SELECT fn, n, p, last, {_STEP} AS line FROM ({_FUNCTIONS}) WHERE last > 1),
w AS (SELECT fn, n, regexp_extract(line, '^(v[12])', 1) AS variable FROM i WHERE n = last AND p % 3 < 2),
o AS (SELECT fn, 'v' || p % 5 AS origin FROM i WHERE n = 1 UNION SELECT fn, 'amount' FROM i WHERE n = 1 UNION SELECT fn, 'v' || p % 4 FROM i WHERE n > 1 AND n < last AND p % 7 <> 0 AND p % 3 = 0),
t AS (SELECT fn, 'token' AS origin FROM i WHERE n > 1 AND n < last AND p % 7 = 0),
c AS (SELECT DISTINCT fn FROM t)
SELECT w.fn, w.variable, (SELECT string_agg(origin, ',' ORDER BY origin) FROM (SELECT origin FROM o WHERE o.fn = w.fn UNION SELECT origin FROM t WHERE t.fn = w.fn) x) AS depends_on, c.fn IS NOT NULL AS after_call FROM w LEFT JOIN c ON w.fn = c.fn""")
def p30(spark, sf):
    """What the state variables that functions write depend on, through all temporaries."""
    items = views.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "fn")  # first, so that windows lie as transitions wants lines
    own = Window.partitionBy("fn")
    place = F.row_number().over(own.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    steps = items.select("fn", place.alias("n"), F.col("l_partkey").alias("p"), F.count("*").over(own).alias("last"))
    lines = steps.where("last > 1").select("fn", "n", F.expr(_STEP).alias("line"))
    state = spark.createDataFrame([(f"v{i}",) for i in range(5)], "variable string")
    return flows.transitions(lines, state, "fn").withColumn("depends_on", F.array_join("depends_on", ","))


# ---- vectors of code ------------------------------------------------------------------------------

_COUNTS = ", ".join(f"len(regexp_extract_all(code, '{_re(p)}'))" for p in embed.STRUCTURE.values())
_EMBEDDED = f"""d AS (SELECT doc_id, code, regexp_extract_all(code, '{code.TOKEN}') AS t FROM masked),
runs AS (SELECT doc_id, unnest([array_to_string(t[i:i + n - 1], ' ') FOR i IN range(1, len(t) - n + 2)]) AS run FROM d, (VALUES (1), (2), (3)) z(n)),
h AS (SELECT doc_id, {len(embed.STRUCTURE)} + ('0x' || substr(md5(run), 1, 7))::BIGINT % {embed.DIMENSIONS - len(embed.STRUCTURE)} AS dim, 1 - 2 * (('0x' || substr(md5(run), 8, 7))::BIGINT % 2) AS n FROM runs
 UNION ALL SELECT doc_id, i - 1, c[i] FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, [{_COUNTS}] AS c FROM d))),
w AS (SELECT doc_id, dim, sign(sum(n)) * ln(1 + abs(sum(n))) AS w FROM h GROUP BY doc_id, dim)"""


@query("t4_code_vectors", f"{_EMBEDDED} SELECT doc_id, dim::INT AS dim, round_even(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS value FROM w WHERE w <> 0")
def t4(spark, sf):
    """Vectors of code by signed hashes of token runs and counts of structures, as one row a component."""
    rows = embed.code_vectors(views.contracts(spark, sf)).select("doc_id", F.posexplode("vector").alias("dim", "value"))
    return rows.where("value <> 0").withColumn("value", F.bround("value", 6))


@query("t4_similar_code", f"""{_EMBEDDED}, l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM w GROUP BY doc_id), x AS (SELECT w.doc_id, dim, w / l AS v FROM w JOIN l USING (doc_id)),
s AS (SELECT a.doc_id AS query, b.doc_id, round_even(sum(a.v * b.v), 9) AS similarity FROM x a JOIN x b ON a.dim = b.dim AND a.doc_id <> b.doc_id WHERE a.doc_id % 100 = 0 GROUP BY a.doc_id, b.doc_id)
SELECT query, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc_id) AS rank FROM s) WHERE rank = 1""")
def t4_similar(spark, sf):
    """The likeness of the nearest other contract to every hundredth one, through an index of code vectors."""
    from pelagos.plans.documents import _folder

    path = _folder(spark)
    embed.code_vectors(views.contracts(spark, sf)).select(F.col("doc_id").alias("vec_id"), F.col("vector").alias("embedding")).write.parquet(f"{path}-vectors")
    rows = spark.read.parquet(f"{path}-vectors")
    vindex.build(rows, path, lists=16)
    return vindex.search(spark, path, rows.where("vec_id % 100 = 0"), 1, None).select("query", "similarity")


# ---- advisories by version ------------------------------------------------------------------------

_ADVISORIES = [
    ("@open/kit0", None, "1.5.0", "K-1"), ("@open/kit0", "2.0.0", "2.4.2", "K-2"), ("@open/kit0", "2.4.2", None, "K-3"), ("@open/kit1", "1.10.0", "3.2.0", "K-4"), ("@open/kit1", "3.2.1", "3.3.0", "K-5"), ("@other", None, None, "K-6"),
]
_RANGES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in _ADVISORIES)


@query("t26_advised_versions", f"""a(package, introduced, fixed, advisory) AS (VALUES {_RANGES}),
r AS (SELECT package, advisory, [coalesce(string_split(introduced, '.')[i]::INT, 0) FOR i IN [1, 2, 3]] AS low, CASE WHEN fixed IS NOT NULL THEN [string_split(fixed, '.')[i]::INT FOR i IN [1, 2, 3]] END AS high FROM a),
d AS (SELECT doc_id, '@open/kit' || doc_id % 2 AS package, doc_id % 4 || '.' || doc_id % 11 || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '.' || doc_id % 9 END AS version, [doc_id % 4, doc_id % 11, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id % 9 END] AS v FROM contracts)
SELECT d.doc_id, d.package, d.version, r.advisory FROM d JOIN r ON d.package = r.package AND d.v >= r.low AND (r.high IS NULL OR d.v < r.high)""")
def t26_versions(spark, sf):
    """Imports whose version an advisory's range holds; ranges may have open ends."""
    advisories = spark.createDataFrame(_ADVISORIES, "package string, introduced string, fixed string, advisory string")
    return code.advised(code.versioned_imports(views.contracts(spark, sf)), advisories)


# ---- nested JSON within limits --------------------------------------------------------------------

#: A body per event: some nest too deep, some have lists or texts that are too long, some are broken.
_BODY = """CASE WHEN event_id % 10 = 0 THEN repeat('[', CAST(5 + event_id % 7 AS INT)) || '1' || repeat(']', CAST(5 + event_id % 7 AS INT))
 WHEN event_id % 10 = 1 THEN '{"items": [' || repeat('1, ', CAST(94 + event_id % 13 AS INT)) || '2], "k": {"a": null, "b": true}}'
 WHEN event_id % 10 = 2 THEN '{"t": "' || repeat('ab', CAST(2495 + event_id % 11 AS INT)) || '"}'
 WHEN event_id % 10 = 3 THEN '{"broken": ' ELSE '{"k": {"list": [1, 2.5, "x", {"y": false}]}, "n": ' || event_id || '}' END"""


@query("t15_bounded_json", f"SELECT event_id FROM events WHERE CASE event_id % 10 WHEN 0 THEN 5 + event_id % 7 <= 8 WHEN 1 THEN 95 + event_id % 13 <= 100 WHEN 2 THEN 2 * (2495 + event_id % 11) <= 5000 WHEN 3 THEN false ELSE true END")
def t15(spark, sf):
    """Bodies of which no value is beyond a limit."""
    docs = views.table(spark, sf, "events").select("event_id", F.expr(_BODY).alias("body"))
    return bounded.within_limits(docs, "event_id").select("event_id")


# ---- sessions with timers -------------------------------------------------------------------------

_SESSIONS = """e AS (SELECT event_id, user_id, event_type, ts, epoch_us(ts) AS t FROM events),
f AS (SELECT *, coalesce(t - lag(t) OVER w > {silence} OR {ends}, true) AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM f),
g AS (SELECT user_id, n, min(ts) AS began, max(ts) AS last, max(t) AS t, count(*) AS steps, count(*) FILTER (WHERE event_type = 'error') AS failed_steps, arg_max(event_type, (ts, event_id)) AS kind, n = max(n) OVER (PARTITION BY user_id) AS newest FROM n GROUP BY user_id, n)"""


@query("x4_ended_sessions", _SESSIONS.format(silence=259_200_000_000, ends="lag(event_type) OVER w = 'purchase'") + """
SELECT user_id::VARCHAR AS session, began, last, steps, failed_steps, CASE kind WHEN 'purchase' THEN 'completed' ELSE 'timed_out' END AS state FROM g WHERE kind = 'purchase' OR NOT newest OR t + 259200000000 < (SELECT max(t) FROM e)""")
def x4(spark, sf):
    """Sessions that a purchase has completed or three days of silence have ended."""
    got = sessions.ended(views.table(spark, sf, "events"), "user_id", "ts", "event_type", "event_id", {"purchase": "completed"}, 259_200, "error")
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("began", "last")})


@query("x6_silent_clients", _SESSIONS.format(silence=172_800_000_000, ends="false") + """
SELECT user_id::VARCHAR AS session, last, steps FROM g WHERE NOT newest OR t + 172800000000 < (SELECT max(t) FROM e)""")
def x6(spark, sf):
    """Clients that were not heard of for two days, each time."""
    return sessions.silent(views.table(spark, sf, "events"), "user_id", "ts", "event_id", 172_800).withColumn("last", F.col("last").cast("timestamp_ntz"))
