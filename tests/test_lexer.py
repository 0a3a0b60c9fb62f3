"""Masks against a character loop, scopes against a plain parser, and the rules and functions that rest on them."""

import random

import pytest
from pyspark.sql import functions as F

from pelagos.operators import code, lexer


def plain_mask(text, strings=True):
    """One character after the other: in code, in a string, in a line comment or in a block comment."""
    out, i, n = [], 0, len(text)
    while i < n:
        if text[i] in "\"'":
            quote, j = text[i], i + 1
            while j < n and text[j] not in (quote, "\n"):
                if text[j] == "\\":
                    if j + 1 >= n or text[j + 1] == "\n":
                        break
                    j += 1
                j += 1
            closed = j < n and text[j] == quote
            end = j + 1 if closed else j
            whole = text[i:end]
            if strings:
                tail = whole[-1] == quote and len(whole) > 1
                whole = quote + " " * (len(whole) - 1 - tail) + quote * tail
            out.append(whole)
        elif text.startswith("//", i):
            end = text.find("\n", i)
            end = n if end < 0 else end
            out.append(" " * (end - i))
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            out.append("".join(c if c == "\n" else " " for c in text[i:end]))
        else:
            end = i + 1
            out.append(text[i])
        i = end
    return "".join(out)


def test_masks_against_a_character_loop(spark):
    random.seed(7)
    pieces = ['"', "'", "//", "/*", "*/", "\n", "\\", "{", "}", "a", " ", "https://x", "ü", "\U0001f600", '\\"']
    texts = ["".join(random.choice(pieces) for _ in range(random.randrange(40))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: (r.a, r.b) for r in df.select("k", lexer.masked(F.col("t")).alias("a"), lexer.masked(F.col("t"), False).alias("b")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == (plain_mask(t), plain_mask(t, False)), t
        assert len(got[k][0]) == len(t)


def test_long_marks_do_not_overflow(spark):
    texts = ['"' + '\\"' * 200_000 + '"; x', "/*" + "* " * 300_000 + "*/ y", "//" + "a" * 500_000, "'" * 100_001]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.length(lexer.masked(F.col("t"))).alias("n")).collect()
    assert [r.n for r in rows] == [len(t) for t in texts]
    assert spark.createDataFrame([(None,), ("",)], "t string").select(lexer.masked(F.col("t"))).collect() == [(None,), ("",)]


ODD = '''contract A is B {
  string memory s = "https://x.y"; // function ghost() {
  function one(uint x) public {
    string memory s = "https://x.y"; owner.call{value: 1}("");
    string memory t = "}"; if (x > 0) { function (uint) external g; selfdestruct(owner); }
  }
  // see /*
  modifier only() { require(msg.sender == o, "tx.origin == o"); _; }
  function() external payable { }
  function later() external;
  receive() external payable { x = 1; }
}
/* contract C { */
library L { function two() internal returns (uint) { unchecked { return 1; } } }
contract D { function open() public { a();
'''


def test_scopes_nest(spark):
    df = spark.createDataFrame([(1, ODD)], "doc_id long, text string")
    rows = {r.scope: r for r in lexer.scopes(df).collect()}
    shape = [(r.kind, r.name, r.depth, rows[r.parent].name if r.parent >= 0 else None) for _, r in sorted(rows.items())]
    assert shape == [
        ("contract", "A", 0, None), ("function", "one", 1, "A"), ("block", "", 2, "one"), ("block", "", 2, "one"), ("modifier", "only", 1, "A"), ("function", "fallback", 1, "A"),
        ("receive", "receive", 1, "A"), ("library", "L", 0, None), ("function", "two", 1, "L"), ("block", "", 2, "two"), ("contract", "D", 0, None), ("function", "open", 1, "D"),
    ]
    functions = {r.name: r for r in lexer.functions(df).collect()}
    assert set(functions) == {"one", "only", "fallback", "receive", "two", "open"}
    assert (functions["one"].first_line, functions["one"].last_line) == (3, 6) and "selfdestruct" in functions["one"].body
    assert (functions["open"].first_line, functions["open"].last_line, functions["open"].holder) == (15, 15, "D")
    assert "tx.origin" not in functions["only"].body


def test_rules_read_code_only(spark):
    df = spark.createDataFrame([(1, ODD)], "doc_id long, text string")
    hits = {(r.line_no, r.rule) for r in code.detect(df).collect()}
    assert (4, "call-with-value") in hits and (5, "contract-ends") in hits
    assert not any(rule == "origin-compared" for _, rule in hits)


def test_guards_hold_within_their_function_only(spark):
    text = "contract A {\n function a() public onlyOwner {\n  x();\n }\n function b() public {\n  selfdestruct(o);\n }\n}\n"
    df = spark.createDataFrame([(1, text), (2, text.replace("function b() public", "function b() public onlyOwner"))], "doc_id long, text string")
    assert [(r.doc_id, r.line_no, r.rule) for r in code.detect(df).collect()] == [(1, 6, "contract-ends")]


@pytest.mark.parametrize("text", ["", "}}}{", "function", "function f(", "contract { function f() { }", "{" * 3000 + "}" * 3000])
def test_broken_code_ends(text):
    for s in lexer.outline(text):
        assert 0 <= s.start <= s.opens < s.closes <= len(text)
