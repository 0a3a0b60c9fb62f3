"""Source text as rows: functions, calls, comments, pragmas, imports, ordering rules.

Strings and comments are masked and functions cut out by ``lexer``; everything after that is expressions and joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos import session
from pelagos.operators import lexer

CALL = r"\b([A-Za-z_]\w*)\s*\("
#: Words before a bracket that call nothing.
NOT_CALLS = ("if", "for", "while", "require", "assert", "revert", "return", "emit", "function", "modifier", "catch", "new", "mapping", "assembly", "unchecked")


def without_comments(code: Column) -> Column:
    """Blanks for comments; strings, line ends and offsets stay."""
    return lexer.masked(code, strings=False)


def normalized(code: Column) -> Column:
    """Comments and repeated blanks out: what clone detection compares."""
    return F.trim(F.regexp_replace(without_comments(code), r"\s+", " "))


functions = lexer.functions


def called_names() -> Column:
    """The different names that the text in ``body`` calls."""
    return F.array_except(F.array_distinct(F.regexp_extract_all("body", F.lit(CALL), F.lit(1))), F.array(*map(F.lit, NOT_CALLS)))


def calls(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Edges ``(key, src, dst)`` of the call graph, within documents."""
    here = F.collect_set("src").over(Window.partitionBy(key))  # the function names of one document
    called = blocks.where(F.col(key).isNotNull()).select(key, F.col("name").alias("src"), called_names().alias("names")).withColumn("here", here)
    return called.select(key, "src", F.explode(F.array_intersect("names", "here")).alias("dst")).distinct()


def nodes(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Flags of each function: visibility, guard, external call, state write after it (checks, effects, interactions)."""
    external = r"\.(?:call|send|transfer|delegatecall)\b"
    seen = F.when(F.col("head").rlike(r"\b(external|public)\b"), "open").otherwise("closed")
    after = F.regexp_extract("body", rf"(?s){external}(.*)$", 1)
    return blocks.select(
        key, "name", seen.alias("visibility"), F.col("head").rlike(r"\bonly\w+|nonReentrant\b").alias("guarded"), F.col("body").rlike(external).alias("calls_out"),
        after.rlike(r"(?m)^\s*\w+(?:\[[^\]]*\])*\s*(?:[-+]?=)[^=]").alias("writes_after"),
    )


def unsafe_order(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Open functions without a guard that write state after a call out."""
    return nodes(blocks, key).where("visibility = 'open' and not guarded and calls_out and writes_after").select(key, "name")


def pragma(code: Column) -> Column:
    """Compiler version as a number that compares: major * 10^6 + minor * 10^3 + patch; null without one."""

    def number(plain: Column) -> Column:
        part = lambda i: F.regexp_extract(plain, r"pragma\s+solidity\s+[^0-9;]*([0-9]+)\.([0-9]+)(?:\.([0-9]+))?", i)
        value = part(1).try_cast("int") * 1_000_000 + part(2).try_cast("int") * 1_000 + F.coalesce(part(3).try_cast("int"), F.lit(0))
        return F.when(part(1) != "", value)

    return F.transform(F.array(without_comments(code)), number)[0]  # masked once, read four times


def imports(docs: DataFrame, advisories: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Imports that an advisory names: ``advisories(package, advisory)`` by the head of the import's path."""
    paths = F.regexp_extract_all(without_comments(F.col(text)), F.lit(r"import\s+(?:[^\"';]*?from\s+)?[\"']([^\"']+)[\"']"), F.lit(1))
    found = docs.select(key, F.explode(F.array_distinct(paths)).alias("path")).withColumn("package", F.regexp_extract("path", r"^(@[^/]+/[^/]+|[^/]+)", 1))
    return found.join(advisories, "package").select(key, "path", "advisory")


def version_key(version: Column) -> Column:
    """``major.minor.patch`` as a number that compares, a part that is missing as 0; null where no number begins it. What
    stands before the first digit (``^``, ``~``, ``v``, ``>=``) and after the third part does not count."""
    part = lambda i: F.regexp_extract(version, r"^[^0-9]*(\d+)(?:\.(\d+))?(?:\.(\d+))?", i)
    number = lambda i: F.coalesce(part(i).try_cast("long"), F.lit(0))
    return F.when(part(1) != "", number(1) * 1_000_000_000_000 + number(2) * 1_000_000 + number(3))


def versioned_imports(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, package, version)`` of imports that name a version: ``package@version/path``, scoped packages too."""
    paths = F.regexp_extract_all(without_comments(F.col(text)), F.lit(r"import\s+(?:[^\"';]*?from\s+)?[\"']([^\"']+)[\"']"), F.lit(1))
    part = lambda i: F.regexp_extract("path", r"^(@[^/@]+/[^/@]+|[^/@]+)@([^/]+)", i)
    found = docs.select(key, F.explode(F.array_distinct(paths)).alias("path"))
    return found.where(part(1) != "").select(key, part(1).alias("package"), part(2).alias("version")).distinct()


def advised(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """``dependencies(package, version, ...)`` with the ``advisory`` of each range of ``advisories(package, introduced, fixed,
    advisory)`` that holds their version: from ``introduced`` on (null: from the first), before ``fixed`` (null: without end).
    Versions meet ranges by package and compare as numbers; one that is none meets no range."""
    low, high = F.coalesce(version_key(F.col("introduced")), F.lit(0)), F.coalesce(version_key(F.col("fixed")), F.lit((1 << 63) - 1))
    ranges = advisories.select(F.col("package").alias("package__"), low.alias("low__"), high.alias("high__"), "advisory")
    at = version_key(F.col("version"))
    on = (F.col("package") == F.col("package__")) & (at >= F.col("low__")) & (at < F.col("high__"))
    return dependencies.join(ranges, on).drop("package__", "low__", "high__")


def ir_calls(lines: DataFrame, line: str = "line") -> DataFrame:
    """Calls in lines of intermediate code: kind, target, destination; other lines are left out."""
    shape = r"(HIGH_LEVEL_CALL|LOW_LEVEL_CALL|INTERNAL_CALL|SEND|TRANSFER),?\s*(?:dest:)?\s*([\w.$]*)[^,]*,?\s*(?:function:)?\s*([\w.$]*)"
    part = lambda i: F.regexp_extract(line, shape, i)
    return lines.select("*", part(1).alias("kind"), part(2).alias("destination"), part(3).alias("target")).where("kind <> ''")


#: Rules over code: name, pattern, pattern that makes it harmless, where that must stand (within some lines, in the function, in
#: the file), category, severity.
CODE_RULES = [
    ("call-with-value", r"\.call\s*\{\s*value|\.call\.value\s*\(", r"\bnonReentrant\b", "function", "reentrancy", "high"),
    ("origin-compared", r"\btx\.origin\s*[!=]=|[!=]=\s*tx\.origin\b", None, "line", "access-control", "high"),
    ("contract-ends", r"\b(?:selfdestruct|suicide)\b\s*\(", r"\bonlyOwner\b", "function", "access-control", "critical"),
    ("foreign-code", r"\.delegatecall\s*[({]", None, "line", "access-control", "high"),
    ("clock-read", r"\b(?:block\s*\.\s*timestamp|now)\b", None, "line", "time-manipulation", "low"),
    ("block-as-dice", r"\bblockhash\s*\(|\bblock\.(?:difficulty|prevrandao)\b", r"\bVRF\w*", "file", "bad-randomness", "medium"),
    ("send-unread", r"^\s*[\w.\[\]()]+\.send\s*\(", r"\brequire\b", "window", "unchecked-call", "medium"),
    ("call-unread", r"^\s*[\w.\[\]()]+\.call\s*[({]", r"\(bool\b", "window", "unchecked-call", "medium"),
    ("loop-to-length", r"\bfor\s*\([^;]*;[^;]*\.length\b", r"\bbreak\b", "function", "denial-of-service", "low"),
    ("sends-in-loop", r"\bfor\b.*\.(?:send|transfer)\s*\(", None, "line", "denial-of-service", "medium"),
    ("transient-kept", r"\btstore\s*\(", r"\btstore\s*\([^,]+,\s*0\s*\)", "function", "transient-storage", "medium"),
    ("spot-price", r"\bgetReserves\s*\(|\bslot0\s*\(", r"\bobserve\s*\(|\b[tT][wW][aA][pP]", "file", "oracle", "high"),
    ("endless-approval", r"\bapprove\s*\([^,]+,\s*(?:type\(uint256\)\.max|uint256\(-1\)|~uint256\(0\))", None, "line", "defi", "low"),
    ("assembly", r"\bassembly\s*(?:\"[^\"]*\"\s*)?\{", None, "line", "low-level", "info"),
    ("unchecked-block", r"\bunchecked\s*\{", None, "line", "integer-overflow", "low"),
    ("old-compiler", r"\bpragma\s+solidity\s+[^0-9]*0\.[4-7]\.", r"\busing\s+SafeMath\b", "file", "integer-overflow", "low"),
    ("bridge-unnumbered", r"\b(?:relay|bridge)Message\s*\(", r"\bnonces?\b", "file", "bridge", "high"),
]
def detect(docs: DataFrame, rules: list[tuple] = CODE_RULES, key: str = "doc_id", window: int = 3) -> DataFrame:
    """``(key, line_no, rule, category, severity)``: rule hits in masked code that nothing in the rule's scope makes harmless.

    One reading of the lines for all rules, which tells hits and harmless lines apart by a number. A line's function is the last
    one that begins at or before it and has not ended; lines outside of all functions are one place. Both meet by document, rule
    and place: the line itself and those around it, the function, or the file; so only they are shuffled, never lines, and once.
    """
    ranged = lexer.with_ranges(docs, key).select(key, "first", "last", F.posexplode(F.split("code", "\n")).alias("n", "line"))
    marked = [(i, r[1]) for i, r in enumerate(rules)] + [(i + len(rules), r[2]) for i, r in enumerate(rules) if r[2]]
    marks = F.array(*[F.when(F.col("line").rlike(p), F.lit(m)) for m, p in marked])
    around = F.filter(F.arrays_zip("first", "last"), lambda r: (r["first"] <= F.col("n") + 1) & (r["last"] > F.col("n")))
    block = F.coalesce(F.array_max(F.transform(around, lambda r: r["first"])), F.lit(0))
    found = ranged.select(key, "n", "first", "last", F.explode(marks).alias("m")).where("m is not null").select(key, "n", block.alias("block"), (F.col("m") % len(rules)).alias("i"), (F.col("m") >= len(rules)).alias("guard"))
    table = lambda k, kind: F.element_at(F.array(*[F.lit(r[k]).cast(kind) for r in rules]), F.col("i") + 1)
    reach = F.when(F.col("guard"), window).otherwise(0)
    places = F.when(table(3, "string") == "file", F.array(F.lit(0))).when(table(3, "string") == "function", F.array("block")).otherwise(F.sequence(F.col("n") - reach, F.col("n") + reach))
    placed = found.select(key, "n", "i", "guard", F.explode(places).alias("place"))
    harmless = F.max("guard").over(Window.partitionBy(key, "i", "place"))
    open_hits = placed.withColumn("harmless", harmless).where("not guard and not harmless")
    return open_hits.select(key, (F.col("n") + 1).alias("line_no"), table(0, "string").alias("rule"), table(4, "string").alias("category"), table(5, "string").alias("severity"))


def first_per_category(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """One hit per document and category: the first line, then the first rule."""
    return hits.groupBy(key, "category").agg(F.min(F.struct("line_no", "rule", "severity")).alias("h")).select(key, "category", "h.line_no", "h.rule", "h.severity")


def hit_summary(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per category and severity: hits, documents, first line of all."""
    return hits.groupBy("category", "severity").agg(F.count("*").alias("hits"), F.count_distinct(key).alias("documents"), F.min("line_no").alias("first_line"))


#: Traits that decide which economic rules apply to a contract: patterns of which all must be found.
TRAITS = {
    "vault": (r"\bdeposit\s*\(", r"\bwithdraw\s*\("),
    "token": (r"\btransfer\s*\(", r"\bbalance(?:s|Of)\b"),
    "spot_price": (r"\bgetReserves\s*\(|\bslot0\s*\(",),
    "guarded": (r"\bnonReentrant\b",),
}


def traits(docs: DataFrame, wanted: dict[str, tuple[str, ...]] = TRAITS, key: str = "doc_id") -> DataFrame:
    """A flag per trait: whether all its patterns are found in the code, comments left out."""
    plain = docs.select(key, lexer.masked(F.col("text")).alias("plain"))
    flag = lambda patterns: reduce(lambda a, b: a & b, [F.col("plain").rlike(p) for p in patterns])
    return plain.select(key, *[flag(p).alias(name) for name, p in wanted.items()])


TOKEN = r"[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+|[-+*/%=<>!&|^~]+|[(){}\[\];,.?:]"
KEYWORDS = ("contract", "function", "public", "external", "internal", "private", "return", "if", "else", "for", "while", "emit", "require", "assembly", "import", "pragma", "mapping")


def token_classes(docs: DataFrame, key: str = "doc_id", n: int = 2) -> DataFrame:
    """Per document: tokens of each class, and how many different runs of ``n`` tokens there are."""
    tokens = docs.select(key, F.regexp_extract_all(lexer.masked(F.col("text")), F.lit(TOKEN), F.lit(0)).alias("t"))
    of = lambda test: F.size(F.filter("t", test))
    word = r"^[A-Za-z_$]"
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("t", i, n), " "))
    return tokens.select(
        key, F.size("t").alias("tokens"), of(lambda x: x.isin(*KEYWORDS)).alias("keywords"), of(lambda x: x.rlike(word) & ~x.isin(*KEYWORDS)).alias("identifiers"),
        of(lambda x: x.rlike("^[0-9]")).alias("numbers"), of(lambda x: x.rlike(r"^[-+*/%=<>!&|^~]")).alias("operators"),
        F.when(F.size("t") >= n, F.size(F.array_distinct(runs))).otherwise(0).alias("different_runs"),
    )


def repo_calls(blocks: DataFrame, repo: str, key: str = "doc_id", most: int = 20_000_000) -> DataFrame:
    """Edges ``(repo, src_doc, src, dst_doc, dst)`` of the call graph over all documents of a repository: a call goes to the
    function of that name in the same document if there is one, else to every one in the repository.

    The edges may be as many as the square of a repository's documents. Both sides are made different first, so that edges come
    out of the join once and are neither shuffled nor kept. What a name's edges will be is counted before: its calls are dealt
    to a place per ``most`` edges, its functions sent to each of them, and tasks are as many as leave each about ``most`` edges,
    since by what they read they would be few.
    """
    session.ensure_checkpoint_dir(blocks.sparkSession)
    called = blocks.where(F.col(repo).isNotNull()).select(repo, F.col(key).alias("src_doc"), F.col("name").alias("src"), called_names().alias("names")).withColumn("here", F.collect_set("src").over(Window.partitionBy(repo, "src_doc"))).checkpoint()
    own = called.select(repo, "src_doc", "src", F.col("src_doc").alias("dst_doc"), F.explode(F.array_intersect("names", "here")).alias("dst")).distinct()
    other = called.select(repo, "src_doc", "src", F.explode(F.array_except("names", "here")).alias("dst")).distinct()
    known = called.select(repo, F.col("src_doc").alias("dst_doc"), F.col("src").alias("dst")).distinct()
    count = lambda rows, name: rows.groupBy(repo, "dst").agg(F.count("*").alias(name))
    edges = count(other, "asked").join(session.shuffled(count(known, "there")), [repo, "dst"]).withColumn("edges", F.col("asked") * F.col("there"))
    sized = session.shuffled(edges.select(repo, "dst", "edges", F.least("asked", F.ceil(F.col("edges") / most)).cast("int").alias("places")).checkpoint())
    tasks = max(1, -(-(sized.agg(F.sum("edges")).first()[0] or 0) // most))
    at = [repo, "dst", "place"]
    asks = other.join(sized, [repo, "dst"]).withColumn("place", F.pmod(F.xxhash64("src_doc", "src"), F.col("places")).cast("int")).repartition(tasks, *at)
    sent = known.join(sized, [repo, "dst"]).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1))).select(*at, "dst_doc").repartition(tasks, *at)
    columns = [repo, "src_doc", "src", "dst_doc", "dst"]
    return own.select(*columns).unionByName(asks.join(session.shuffled(sent), at).select(*columns))


def graph_summary(blocks: DataFrame, edges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: functions, open ones, guarded ones, ones that call out, and edges between them."""
    flags = nodes(blocks, key)
    counted = flags.groupBy(key).agg(
        F.count("*").alias("functions"), F.count_if(F.col("visibility") == "open").alias("open"), F.count_if("guarded").alias("guarded"), F.count_if("calls_out").alias("calls_out")
    )
    return counted.join(edges.groupBy(key).agg(F.count("*").alias("edges")), key, "left").na.fill(0, ["edges"])


def state_uses(lines: DataFrame, variables: tuple[str, ...], line: str = "line") -> DataFrame:
    """Lines of intermediate code that assign ``X(type) := Y(type)``: the state variable written, and those read."""
    left = F.regexp_extract(line, r"^\s*(\w+)\([^)]*\)\s*:?=", 1)
    right = F.regexp_extract(line, r":?=\s*(.*)$", 1)
    names = F.array_distinct(F.regexp_extract_all(right, F.lit(r"(\w+)\("), F.lit(1)))
    state = F.array(*map(F.lit, variables))
    rows = lines.select("*", F.when(F.array_contains(state, left), left).alias("written"), F.array_sort(F.array_intersect(names, state)).alias("read"))
    return rows.where("written is not null or size(read) > 0")


def indicator_score(docs: DataFrame, indicators: list[str], anti: list[str], severity_bonus: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pattern confidence: 0.7 for each indicator occurrence per indicator, less up to 0.4 for anti-patterns, plus the
    severity's bonus and 0.2, clamped to [0, 1]; documents without an indicator are left out."""
    times = lambda patterns: sum((F.regexp_count(text, F.lit(p)) for p in patterns), F.lit(0))
    found, against = times(indicators), sum((F.col(text).rlike(p).cast("int") for p in anti), F.lit(0))
    score = 0.7 * found / len(indicators) - F.least(F.lit(0.4), 0.1 * against) + severity_bonus + 0.2
    return docs.select(key, found.alias("found"), F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6).alias("confidence")).where("found > 0")


def graph_of_output(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions ``(ord, name, visibility)`` and edges ``(ord, src, dst)`` of a call graph that a tool has printed as JSON,
    ``docs(ord, body)``; a visibility that is none of the language's is public."""
    shape = "struct<elements:array<struct<type:string,name:string,source:string,target:string,additional_fields:struct<visibility:string>>>>"
    e = docs.select("ord", F.explode(F.from_json("body", shape)["elements"]).alias("e")).select("ord", "e.*")
    seen = F.when(F.col("additional_fields.visibility").isin("public", "external", "internal", "private"), F.col("additional_fields.visibility")).otherwise("public")
    functions_ = e.where("type = 'function'").select("ord", F.coalesce("name", F.lit("unknown")).alias("name"), seen.alias("visibility")).distinct()
    edges = e.where("type = 'edge' and source <> '' and target <> ''").select("ord", F.col("source").alias("src"), F.col("target").alias("dst")).distinct()
    return functions_, edges


def context_verdicts(findings: DataFrame, blocks: DataFrame, benign: dict[str, str], doubtful: str, key: str = "doc_id") -> DataFrame:
    """``(ord, verdict)`` of ``findings(ord, key, line, type)``: dropped if the function around the line holds what makes its type
    benign, review if there is no function or it holds a ``doubtful`` guard, else kept. Lines meet functions by document."""
    code_ = F.concat_ws("\n", "head", "body")
    signs = {f"sign{i}": code_.rlike(p) for i, p in enumerate([doubtful, *benign.values()])}
    read = blocks.select(key, "first_line", "last_line", *[F.coalesce(s, F.lit(False)).alias(n) for n, s in signs.items()])  # flags meet findings, texts do not
    around = findings.join(session.shuffled(read), key).where(F.col("line").between(F.col("first_line"), F.col("last_line")))
    harmless = F.lit(False)
    for i, kind in enumerate(benign, 1):
        harmless = harmless | ((F.col("type") == kind) & F.col(f"sign{i}"))
    judged = around.groupBy("ord").agg(F.max(harmless.cast("int")).alias("harmless"), F.max(F.col("sign0").cast("int")).alias("doubt"))
    verdict = F.when(F.col("harmless") == 1, "dropped").when(F.col("harmless").isNull() | (F.col("doubt") == 1), "review").otherwise("kept")
    return findings.select("ord").join(session.shuffled(judged), "ord", "left").select("ord", verdict.alias("verdict"))
