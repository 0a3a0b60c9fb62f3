"""Taint by statements against a plain walk, rules across functions, intermediate code."""

import random
import re

import pytest

from pelagos import catalog
from pelagos.operators import crossing, flows, lexer


def contract(body, head="function f(uint p) public"):
    return f"contract A {{ {head} {{ {body} }} }}"


def tainted(spark, *bodies, head="function f(uint p) public"):
    docs = spark.createDataFrame([(i, contract(b, head)) for i, b in enumerate(bodies)], "doc_id long, text string")
    return {(r.doc_id, r.sink, r.variable, r.source, r.checked) for r in flows.tainted(lexer.functions(docs)).collect()}


def test_a_variable_assigned_anew_is_clean(spark):
    got = tainted(
        spark,
        "x = p; x = 1; to.call(x);",
        "x = p; to.call(x); x = 1;",
        "x = p; x += 1; to.call(x);",
        "x = p; y = x; z = y; x = 0; to.send(z);",
        "a[p] = 1; to.send(a);",
        "x = p; require(x > 0); to.transfer(x);",
        "require(p > 0); x = p; p = 3; to.transfer(x); y = p; selfdestruct(y);",
        "address t = msg.sender; t.delegatecall(p);",
        'to.call{value: p}(""); emit Done(p);',
        "if (q > 0) { x = block.timestamp; } to.send(x);",
        "msg.sender.call(1);",
        "x = owner; x.call(2);",
    )
    param = flows.PARAMETER
    assert got == {
        (1, "call", "x", param, False), (2, "call", "x", param, False), (3, "send", "z", param, False), (4, "send", "a", param, False), (5, "transfer", "x", param, True), (6, "transfer", "x", param, True),
        (7, "delegatecall", "t", "msg.sender", False), (7, "delegatecall", "p", param, False), (8, "call", "p", param, False), (9, "send", "x", "block.timestamp", False), (10, "call", "msg.sender", "msg.sender", False),
    }


def plain(body):
    """States of variables, one statement after the other: (source, checked) pairs each may hold."""
    state, found = {"p": {(flows.PARAMETER, False)}}, set()
    for s in filter(str.strip, re.split("[;{}]", body)):
        if m := re.match(r"\s*(\w+) (\+?)= (.*)", s):
            used = set(re.findall(r"[a-z]\w*", m[3].replace("msg.value", ""))) | ({m[1]} if m[2] else set())
            new = {("msg.value", False)} if "msg.value" in m[3] else set()
            state[m[1]] = new | {x for v in used for x in state.get(v, ())}
        elif m := re.match(r"\s*require\((\w+) > 0\)", s):
            if m[1] in state:
                state[m[1]] = {(label, True) for label, _ in state[m[1]]}
        elif m := re.match(r"\s*(\w+)\.send\((\w+)\)", s):
            found |= {("send", v, label, checked) for v in (m[1], m[2]) for label, checked in state.get(v, ())}
    return {(*k, all(c for *j, c in found if tuple(j) == k)) for k in {tuple(f[:3]) for f in found}}


def test_against_a_plain_walk(spark):
    random.seed(9)
    names = "abcdp"
    bodies = []
    for _ in range(60):
        some = lambda: random.choice(names)
        kinds = [lambda: f"{some()} = {some()} + {some()}", lambda: f"{some()} += {some()}", lambda: f"{some()} = 1", lambda: f"{some()} = msg.value", lambda: f"require({some()} > 0)", lambda: "e.send(" + some() + ")"]
        body = "; ".join(random.choice(kinds)() for _ in range(random.randrange(4, 14))) + ";"
        bodies.append(re.sub(r"(e\.send.*?);", lambda m: m[1] + ";", body))
    got = tainted(spark, *bodies)
    for i, body in enumerate(bodies):
        sent = {}
        for f in {g[1:] for g in got if g[0] == i}:
            sent.setdefault(f[:3], set()).add(f[3])
        assert {(*k, all(v)) for k, v in sent.items()} == plain(body), body


def test_severities_and_endless_chains(spark):
    docs = spark.createDataFrame([(1, contract("x = msg.value; a.send(x); a.call(x); a.send(p); a.call(p);"))], "doc_id long, text string")
    rows = {(r.sink, r.source): r.severity for r in flows.tainted(lexer.functions(docs)).collect()}
    assert rows == {("send", "msg.value"): "low", ("call", "msg.value"): "high", ("send", flows.PARAMETER): "medium", ("call", flows.PARAMETER): "critical"}
    chain = "".join(f"v{i + 1} = v{i};" for i in range(8))
    long = spark.createDataFrame([(1, contract("v0 = p;" + chain + "a.send(v8);"))], "doc_id long, text string")
    assert flows.tainted(lexer.functions(long)).count() == 1
    with pytest.raises(RuntimeError, match="more than 3"):
        flows.tainted(lexer.functions(long), rounds=3)


def test_components_and_folding_with_circles(spark):
    edges = spark.createDataFrame([(1, *e) for e in ("ab", "bc", "ca", "cd", "de", "ed", "ff", "gf")] + [(2, "a", "b")], "doc_id long, src string, dst string")
    got = {(r.doc_id, r.node): r.component for r in crossing.components(edges).collect()}
    assert got == {(1, "a"): "a", (1, "b"): "a", (1, "c"): "a", (1, "d"): "d", (1, "e"): "d", (1, "f"): "f", (1, "g"): "g", (2, "a"): "a", (2, "b"): "b"}
    own = spark.createDataFrame([(1, "e", "t")], "doc_id long, name string, trait string")
    none = spark.createDataFrame([], "doc_id long, name string")
    assert {(r.name, r.via) for r in crossing.folded(own, edges, none).collect()} == {("e", "e"), ("d", "e"), ("c", "a"), ("b", "c"), ("a", "b")}
    stop = spark.createDataFrame([(1, "d")], "doc_id long, name string")
    assert {(r.name, r.via) for r in crossing.folded(own, edges, stop).collect()} == {("e", "e"), ("d", "e")}


WEB = """contract A {
  function open() public { middle(); }
  function middle() internal { back(); }
  function back() internal { if (x) { middle(); } owner = msg.sender; }
  function kept() public onlyOwner { middle(); }
  function asked() external { require(msg.sender == owner); owner = x; }
  function behind() external { asked(); }
  function join(address a) external { list.push(a); }
  function round() public { for (uint i = 0; i < list.length; i++) { if (ok) { one(i); } } }
  function one(uint i) internal { list[i].transfer(1); }
  function quiet() public { while (x > 0) { x--; } one(2); }
  // function ghost() public { owner = x; }
}"""


def test_rules_across_functions(spark):
    docs = spark.createDataFrame([(1, WEB)], "doc_id long, text string")
    assert {tuple(r)[1:] for r in crossing.findings(docs).collect()} == {("open-privilege", "open", "middle"), ("call-in-loop", "round", "round"), ("growing-loop", "join", "round")}


def test_loops_are_cut_out():
    body = "for (uint i = 0; i < f(n); i++) { a(); while (x) y(); } while (z) { } for (;;) q{value: 1}(); for (a"
    assert [(h, b.strip()) for _, h, b in lexer.loops_of(body)] == [("uint i = 0; i < f(n); i++", "a(); while (x) y();"), ("x", "y()"), ("z", ""), (";;", "q{value: 1}()"), ("a", "")]


def test_temporaries_resolve_to_state(spark):
    lines = ["TMP_1(uint256) = a(uint256) + n(uint256)"] + [f"TMP_{i + 1}(uint256) = TMP_{i}(uint256) + 1(uint256)" for i in range(1, 6)]
    lines += ["total(uint256) := TMP_6(uint256)", "REF_1(uint256) -> balances[who]", "TMP_8(bool) = LOW_LEVEL_CALL, dest:TMP_9(address), function:call, arguments:[n(uint256)]", "REF_1(uint256) := TMP_6(uint256)", "RETURN TMP_6"]
    rows = spark.createDataFrame([("f", i, line) for i, line in enumerate(lines)] + [("g", 0, "a(uint256) := b(uint256)")], "fn string, n int, line string")
    state = spark.createDataFrame([("total",), ("balances",), ("a",)], "variable string")
    got = {(r.fn, r.variable): (r.depends_on, r.after_call) for r in flows.transitions(rows, state, "fn").collect()}
    assert got[("f", "total")] == (["a", "n"], False) and got[("g", "a")] == (["b"], False)
    assert got[("f", "balances")] == (["a", "n"], True)


def test_circles_of_temporaries_end(spark):
    rows = spark.createDataFrame([("f", 0, "TMP_1(x) = TMP_2(x) + a(x)"), ("f", 1, "TMP_2(x) = TMP_1(x) + b(x)"), ("f", 2, "s(x) := TMP_1(x)")], "fn string, n int, line string")
    state = spark.createDataFrame([("s",)], "variable string")
    (row,) = flows.transitions(rows, state, "fn").collect()
    assert {"a", "b"} <= set(row.depends_on)


def test_transitions_shuffle_lines_once_and_circles_end(spark):
    """Lines that lie together by function are not dealt again, functions may be longer than a batch, circles of three end."""
    ring = ["TMP_1(x) = TMP_2(x) + a(x)", "TMP_2(x) = TMP_3(x)", "TMP_3(x) = TMP_1(x)", "s(x) := TMP_1(x)", "SEND dest:q value:1", "s(x) := TMP_9(x)", "q(x) := b(x)"]
    rows = [("ring", i, line) for i, line in enumerate(ring)] + [(None, 0, "s(x) := a(x)")] + [("long", i, f"TMP_{i}(x) = TMP_{i - 1}(x) + c{i % 3}(x)" if i else "TMP_0(x) = a(x)") for i in range(12_000)] + [("long", 12_000, "s(x) := TMP_11999(x)")]
    lines = spark.createDataFrame(rows, "fn string, n int, line string")
    state = spark.createDataFrame([("s",), ("s",)], "variable string")
    plans, frame = [], type(lines)
    keep = frame.checkpoint
    frame.checkpoint = lambda df, *a, **k: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, *a, **k))[1]
    try:
        found = flows.transitions(lines, state, "fn")
        catalog.queries()["p30_state_transitions"](spark, "/root/testdata/sf0.001")
    finally:
        frame.checkpoint = keep
    assert {tuple(map(str, r)) for r in found.collect()} == {("ring", "s", "['TMP_9', 'a']", "True"), ("long", "s", "['a', 'c0', 'c1', 'c2']", "False")}
    assert [p.count("hashpartitioning(fn") for p in plans] == [1, 1]
