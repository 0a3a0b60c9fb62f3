"""The engine's inputs as views over the driver's tables, in Spark and in SQL. Each is defined once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagos import session

TOOLS = ("slither", "aderyn", "mythril", "smartllm", "gptscan")
SEVERITIES = ("Critical", "High", "Medium", "Low", "Info")
TYPES = {"click": "reentrancy-eth", "error": "tx-origin", "purchase": "unchecked-transfer", "signup": "timestamp", "view": "arithmetic"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings made of events: tool and severity from digits of the id, file from the user, line from the properties."""
    e = table(spark, sf_dir, "events")
    line = F.get_json_object("props", "$.k").cast("int")
    kind = F.lit(None).cast("string")
    for name, value in TYPES.items():
        kind = F.when(F.col("event_type") == name, value).otherwise(kind)
    base = e.select(
        F.col("event_id").alias("ord"), _pick(TOOLS, F.col("event_id") % 5).alias("tool"), _pick(SEVERITIES, F.floor(F.col("event_id") / 5) % 5).alias("severity"),
        kind.alias("type"), F.concat(F.lit("src/c"), F.col("user_id"), F.lit(".sol")).alias("file"), F.concat(F.lit("f"), line % 4).alias("function"), line.alias("line"),
        F.when(F.col("event_id") % 11 != 0, F.least(F.lit(1.0), F.col("value") / 100)).alias("confidence"), "ts", "value",
    )
    return base.withColumn("message", F.concat("type", F.lit(" in "), "function", F.lit("() (line "), "line", F.lit(")")))


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier run: the findings of most events, some lines moved."""
    return findings(spark, sf_dir).where("ord % 3 <> 1").withColumn("line", F.col("line") + F.when(F.col("ord") % 2 == 0, 7).otherwise(0))


def tool_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    return li.join(s, li["l_suppkey"] == s["s_suppkey"]).select(
        F.col("s_name").alias("tool"), F.col("l_extendedprice").alias("time_ms"), F.col("l_quantity").alias("found"), (F.col("l_returnflag") != "R").alias("success")
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pelagos.operators import text

    return text.lines_of(table(spark, sf_dir, "documents"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call graph of parts: each calls two others, so there are cycles and shared callees."""
    p = table(spark, sf_dir, "part")
    other = F.explode(F.array(F.floor(F.col("p_partkey") / 2), F.floor(F.col("p_partkey") / 3) + 1))
    return p.select(F.col("p_partkey").alias("src"), other.alias("dst")).where("src <> dst").distinct()


#: Source code of one contract per part ``k``, in SQL that reads alike in Spark and in the comparison.
CONTRACT = " || chr(10) || ".join([
    "'pragma solidity ^0.' || (4 + k % 5) || '.' || (k % 20) || ';'",
    "'import \"@lib/pack' || (k % 3) || '/token.sol\";'",
    "'import {X} from \"@open/kit' || (k % 2) || '@' || (k % 4) || '.' || (k % 11) || CASE WHEN k % 5 = 0 THEN '' ELSE '.' || (k % 9) END || '/access/X.sol\";'",
    "'contract C' || k || ' {'",
    "'  // tx.origin == owner'",
    "'  /* } function none() public { // \"'",
    "'     ' || chr(39) || ' */  // function ghost() { /*'",
    "'  function a' || (k % 3) || '(uint x) public ' || CASE WHEN k % 4 = 0 THEN 'onlyOwner ' ELSE '' END || '{'",
    "'    ' || CASE k % 6 WHEN 0 THEN 'msg.sender.call{value: x}(\"\");' WHEN 1 THEN 'require(tx.origin == owner);' WHEN 2 THEN 'selfdestruct(owner);' WHEN 3 THEN 'uint r = uint(blockhash(1));' WHEN 4 THEN 'assembly { tstore(0, x) }' ELSE 'total += x;' END",
    "'    string memory s = \"https://x.y/*}\"; ' || CASE WHEN k % 5 = 1 THEN 'owner.call{value: 1}(\"\");' ELSE 'note(\"' || chr(92) || '\"{ tx.origin == x\"); // see /*' END",
    "'    balances[msg.sender] = 0;'",
    "'  }'",
    "'  function b(uint n) external ' || CASE WHEN k % 3 = 0 THEN 'nonReentrant ' ELSE '' END || '{'",
    "'    a' || (k % 2) || '(1);'",
    "'    for (uint i = 0; i < list.length; i++) { list[i].send(n); }'",
    "'    ' || CASE WHEN k % 5 = 0 THEN 'require(n > 0);' ELSE 'uint p = pair.getReserves();' END",
    "'    ' || CASE k % 7 WHEN 0 THEN 'msg.sender.call{value: n}(\"\"); // twap' WHEN 1 THEN 'twapOf(n);' WHEN 2 THEN 'tstore(0, 0);' ELSE 'emit Done(n);' END",
    "'  }'",
    "'  function c(address who, uint n) external {'",
    "'    address to = who;'",
    "'    uint fee = n / 10;'",
    "'    ' || CASE k % 4 WHEN 0 THEN 'to = owner;' WHEN 1 THEN 'require(to != address(0));' WHEN 2 THEN 'fee += msg.value;' ELSE 'if (n > 0) { a1(n); }' END",
    "'    uint rest = fee + 1;'",
    "'    to.call{value: rest}(\"\");'",
    "'  }'",
    "'}'",
])


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = session.spread(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k")), "k")
    return keys.select(F.col("k").alias("doc_id"), (F.col("k") % 50).alias("repo"), F.expr(CONTRACT).alias("text"))


_TOOL = "[" + ", ".join(f"'{t}'" for t in TOOLS) + "]"
_SEVERITY = "[" + ", ".join(f"'{s}'" for s in SEVERITIES) + "]"
_TYPE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items()) + " END"

#: Strings, line comments and block comments, as the comparison's engine writes them.
_LEX = r"""\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"?|''[^''\\\n]*(?:\\.[^''\\\n]*)*''?|//[^\n]*|/\*(?:.|\n)*?(?:\*/|\z)"""
_BLANK = r"regexp_replace(marks[i], '[^\n]', ' ', 'g')"
_QUOTED = "marks[i][1] || CASE WHEN len(marks[i]) > 1 AND marks[i][-1] = marks[i][1] THEN repeat(' ', len(marks[i]) - 2) || marks[i][1] ELSE repeat(' ', len(marks[i]) - 1) END"

SQL = {
    "findings": f"""SELECT *, type || ' in ' || function || '() (line ' || line || ')' AS message FROM (
  SELECT event_id AS ord, {_TOOL}[event_id % 5 + 1] AS tool, {_SEVERITY}[(event_id // 5) % 5 + 1] AS severity, {_TYPE} AS type,
         'src/c' || user_id || '.sol' AS file, 'f' || (json_extract_string(props, '$.k')::INT % 4) AS function, json_extract_string(props, '$.k')::INT AS line,
         CASE WHEN event_id % 11 <> 0 THEN least(1.0::DOUBLE, value / 100) END AS confidence, ts, value FROM events)""",
    "baseline_run": "SELECT * REPLACE (line + CASE WHEN ord % 2 = 0 THEN 7 ELSE 0 END AS line) FROM findings WHERE ord % 3 <> 1",
    "tool_runs": "SELECT s_name AS tool, l_extendedprice AS time_ms, l_quantity AS found, l_returnflag <> 'R' AS success FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "doc_lines": "SELECT doc_id, n AS line_no, string_split(text, chr(10))[n] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)",
    "contracts": f"SELECT k AS doc_id, k % 50 AS repo, {CONTRACT} AS text FROM (SELECT p_partkey::BIGINT AS k FROM part)",
    "lexed": f"SELECT doc_id, repo, string_split_regex(text, '{_LEX}') AS gaps, regexp_extract_all(text, '{_LEX}') AS marks FROM contracts",
    "masked": f"SELECT doc_id, repo, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || CASE WHEN i > len(marks) THEN '' WHEN marks[i][1] = '/' THEN {_BLANK} ELSE marks[i] END), '') AS kept, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || CASE WHEN i > len(marks) THEN '' WHEN marks[i][1] = '/' THEN {_BLANK} ELSE {_QUOTED} END), '') AS code FROM lexed",
    "deep_lines": "SELECT *, coalesce(sum(d) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(d) OVER (PARTITION BY doc_id ORDER BY n) AS after FROM (SELECT doc_id, repo, n, l[n] AS line, len(l[n]) - len(replace(l[n], '{', '')) - len(l[n]) + len(replace(l[n], '}', '')) AS d FROM (SELECT doc_id, repo, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, repo, string_split(code, chr(10)) AS l FROM masked)))",
    "ranges": "SELECT h.doc_id, h.repo, h.n AS first_line, min(e.n) AS last_line FROM deep_lines h JOIN deep_lines e ON h.doc_id = e.doc_id AND e.n >= h.n AND e.after <= h.before AND contains(e.line, '}') WHERE regexp_matches(h.line, '\\bfunction\\b') GROUP BY h.doc_id, h.repo, h.n",
    "code_lines": "SELECT l.doc_id, l.repo, l.n, any_value(l.line) AS line, coalesce(max(r.first_line), 0) AS block FROM deep_lines l LEFT JOIN ranges r ON l.doc_id = r.doc_id AND l.n BETWEEN r.first_line AND r.last_line GROUP BY l.doc_id, l.repo, l.n",
    "blocks": "SELECT doc_id, repo, first_line AS block, regexp_extract(t, 'function (\\w+)', 1) AS name, substr(t, 1, strpos(t, '{') - 1) AS head, first_line, last_line, regexp_extract(t, '^[^{]*\\{((?:.|\\n)*)\\}[^}]*$', 1) AS body FROM (SELECT r.doc_id, r.repo, r.first_line, r.last_line, string_agg(l.line, chr(10) ORDER BY l.n) AS t FROM ranges r JOIN deep_lines l ON l.doc_id = r.doc_id AND l.n BETWEEN r.first_line AND r.last_line GROUP BY r.doc_id, r.repo, r.first_line, r.last_line)",
    "edges": "SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, unnest([p_partkey // 2, p_partkey // 3 + 1]) AS dst FROM part) WHERE src <> dst",
}
