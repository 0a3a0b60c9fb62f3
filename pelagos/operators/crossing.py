"""Rules that need more than one function: summaries of functions folded over the call graph, from callees to callers.

Functions that call each other in a circle are one component, found as the pairs that reach each other. What a function
does spreads to its callers along the edges of the graph of components, new pairs only in each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos import session
from pelagos.operators import code, lexer

#: What only some may do, as it looks in a function's body.
PRIVILEGED = r"\b(?:selfdestruct|suicide)\s*\(|\.delegatecall\s*[({]|\b_?(?:owner|admin|governor|implementation)\s*=[^=]|\b_?(?:upgradeTo|mint|setOracle)\w*\s*\("
#: What asks who calls: in a head, in a body.
GUARD_HEAD, GUARD_BODY = r"\bonly\w+|\b(?:requiresAuth|auth|initializer)\b", r"(?:require|if)\s*\(\s*(?:msg\.sender|_msgSender\(\))\s*[!=]=|(?:msg\.sender|_msgSender\(\))\s*[!=]=|\b_check(?:Owner|Role)\s*\("
CALLS_OUT = r"\.(?:call|send|transfer|delegatecall)\s*[({]"
GROWS = r"\b(\w+)\.push\s*\("
OVER = r"<=?\s*(\w+)\.length\b"


def components(edges: DataFrame, key: str = "doc_id", rounds: int = 12) -> DataFrame:
    """``(key, node, component)`` of the nodes of ``edges(key, src, dst)``: the least name among those that a node reaches
    and is reached from, itself included. Paths double in each round; graphs stay within their key."""
    session.ensure_checkpoint_dir(edges.sparkSession)
    apart = session.shuffled
    once = paths = edges.select(key, "src", "dst").distinct().checkpoint()
    size = paths.count()
    for _ in range(rounds):
        longer = paths.join(apart(paths.select(key, F.col("src").alias("dst"), F.col("dst").alias("end"))), [key, "dst"]).select(key, "src", F.col("end").alias("dst"))
        paths = paths.unionByName(longer).distinct().checkpoint()
        now = paths.count()
        if now == size:
            break
        size = now
    else:
        raise RuntimeError(f"paths are longer than 2^{rounds}")
    back = paths.select(key, F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = paths.join(apart(back), [key, "src", "dst"])
    nodes = once.select(key, F.explode(F.array("src", "dst")).alias("src")).distinct()
    return nodes.select(key, "src", F.col("src").alias("dst")).unionByName(mutual).groupBy(key, F.col("src").alias("node")).agg(F.min("dst").alias("component"))


def folded(own: DataFrame, edges: DataFrame, stops: DataFrame, key: str = "doc_id", rounds: int = 200) -> DataFrame:
    """``(key, name, trait, via)``: the traits ``own(key, name, trait)`` that a function has itself (``via`` is its name) or
    through what it calls (the least name of a callee that has them). ``stops(key, name)`` pass nothing to callers.

    Components are folded, not functions: inside one every function has what any of it has, unless it stops there.
    """
    session.ensure_checkpoint_dir(own.sparkSession)
    apart = session.shuffled
    passed = edges.join(apart(stops.select(key, F.col("name").alias("dst"))), [key, "dst"], "left_anti").checkpoint()
    member = components(passed, key).checkpoint()
    of = lambda end: member.select(key, F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    condensed = passed.join(apart(of("src")), [key, "src"]).join(apart(of("dst")), [key, "dst"]).where("c_src <> c_dst").select(key, F.col("c_src").alias("up"), F.col("c_dst").alias("down")).distinct().checkpoint()
    known = own.join(apart(member), (own[key] == member[key]) & (own["name"] == member["node"])).select(own[key], "component", "trait").distinct().checkpoint()
    new = known
    for _ in range(rounds):
        step = new.select(key, F.col("component").alias("down"), "trait").join(apart(condensed), [key, "down"]).select(key, F.col("up").alias("component"), "trait").distinct()
        new = step.join(apart(known), [key, "component", "trait"], "left_anti").checkpoint()
        if new.isEmpty():
            break
        known = known.unionByName(new).checkpoint()
    else:
        raise RuntimeError(f"calls nest deeper than {rounds}")
    has = member.join(apart(known), [key, "component"]).select(key, F.col("node").alias("dst"), "trait")
    through = passed.join(apart(has), [key, "dst"]).groupBy(key, F.col("src").alias("name"), "trait").agg(F.min("dst").alias("via"))
    mine = own.select(key, "name", "trait", F.col("name").alias("via")).distinct()
    rest = through.join(apart(mine.select(key, "name", "trait")), [key, "name", "trait"], "left_anti")
    return mine.unionByName(rest.select(key, "name", "trait", "via"))


def traits(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, name, open, guarded, privileged, calls_out)`` of functions; those of one name count as one."""
    shut = F.col("head").rlike(GUARD_HEAD) | F.col("body").rlike(GUARD_BODY)
    flags = blocks.select(key, "name", F.col("head").rlike(r"\b(?:public|external)\b").alias("open"), shut.alias("guarded"), F.col("body").rlike(PRIVILEGED).alias("privileged"), F.col("body").rlike(CALLS_OUT).alias("calls_out"))
    return flags.groupBy(key, "name").agg(F.bool_or("open").alias("open"), F.bool_and("guarded").alias("guarded"), F.bool_or("privileged").alias("privileged"), F.bool_or("calls_out").alias("calls_out"))


def findings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, rule, name, via)``: an open function that nobody is kept from, and where what it does stands.

    - open-privilege: does what is privileged, or calls something that does and asks nobody either;
    - call-in-loop: a loop of it, or of a function it calls, calls out itself or through a callee;
    - growing-loop: an array that it lengthens is run through to its end by some function (``via``).
    """
    session.ensure_checkpoint_dir(docs.sparkSession)
    apart = session.shuffled
    blocks = lexer.functions(docs, key).checkpoint()
    edges = code.calls(blocks, key).checkpoint()
    flags = traits(blocks, key).checkpoint()
    loops = lexer.loops(docs, key).checkpoint()
    named = lambda trait: flags.where(trait).select(key, "name", F.lit(trait).alias("trait"))
    guarded = flags.where("guarded").select(key, "name")
    reached = folded(named("privileged"), edges, guarded, key).join(apart(flags.where("open and not guarded").select(key, "name")), [key, "name"], "left_semi")
    privilege = reached.select(key, F.lit("open-privilege").alias("rule"), "name", "via")
    nobody = guarded.limit(0)
    out = folded(named("calls_out"), edges, nobody, key)
    called = loops.select(key, "name", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(code.CALL), F.lit(1)))).alias("callee"))
    deep = called.join(apart(out.select(key, F.col("name").alias("callee")).distinct()), [key, "callee"], "left_semi").select(key, "name")
    looping = loops.where(F.col("body").rlike(CALLS_OUT)).select(key, "name").unionByName(deep).distinct().withColumn("trait", F.lit("loops_out"))
    loop = folded(looping, edges, nobody, key).join(apart(flags.where("open").select(key, "name")), [key, "name"], "left_semi").select(key, F.lit("call-in-loop").alias("rule"), "name", "via")
    grown = blocks.join(apart(flags.where("open and not guarded").select(key, "name")), [key, "name"], "left_semi").select(key, "name", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(GROWS), F.lit(1)))).alias("array"))
    run = loops.select(key, F.col("name").alias("via"), F.explode(F.array_distinct(F.regexp_extract_all("head", F.lit(OVER), F.lit(1)))).alias("array"))
    growing = grown.join(apart(run), [key, "array"]).groupBy(key, "name").agg(F.min("via").alias("via")).select(key, F.lit("growing-loop").alias("rule"), "name", "via")
    return privilege.unionByName(loop).unionByName(growing)
