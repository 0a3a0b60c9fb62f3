"""The registered queries of the corpus operators, with their production parameters, and their SQL."""

from __future__ import annotations

from hashlib import sha256
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagos.llm import common, fingerprint, language, lines, merkle, mixing, packing, periods, pivots, pseudo, quality, rules, simhash, suffixes

MIX = {"weights": (5, 2, 1), "share": 1.5, "ceiling": 2.0, "seed": 20240229}
CAPACITY = 2048
#: Words of a shingle and bits between linked fingerprints, as the near-duplicate query's contract sets them.
SHINGLE, RADIUS = 3, 3
#: The pipeline's near duplicates: five-word shingles, similarity 0.8 or more.
NEAR = {"width": 5, "similarity": 0.8}
#: Labelled documents of each language that text likelihoods are counted on.
LANGUAGE_SAMPLE = 1000
QUALITY = {"positives": 8000, "unlabelled": 8000}
NEAREST = {"k": 5, "scale": 256, "pivots": 32}
RUNS = {"least": 6, "times": 4}
MERKLE = {"fanout": 16, "k": 2}
LINES = {"min_docs": 5, "depth": 3, "similarity": 0.75}


def tokenizer_path() -> str:
    """The vocabulary the packing query is defined with; installed beside Python on every node."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template recurs; see ``lines.dedup_lines``."""
    return lines.dedup_lines(common.table(spark, sf_dir, "documents"), **LINES)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; see ``quality.fit`` and ``quality.score``."""
    docs = common.table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, common.table(spark, sf_dir, "labels"), **QUALITY))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see ``simhash.near_duplicates``."""
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"), SHINGLE, RADIUS)
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document; see ``packing.pack``."""
    return packing.pack(common.table(spark, sf_dir, "documents"), tokenizer_path(), CAPACITY)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of every document under a network trained on all of them; see ``pseudo.pseudo_likelihood``."""
    return pseudo.pseudo_likelihood(common.table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of what is left of every document; see ``suffixes.remove_repeats``."""
    left = suffixes.remove_repeats(common.table(spark, sf_dir, "documents"), 100)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page, text likelihoods learnt from labelled documents; see ``language.identify``."""
    model = language.fit(common.table(spark, sf_dir, "documents"), LANGUAGE_SAMPLE)
    found = language.identify(language.page_evidence(common.table(spark, sf_dir, "pages")), model, markup=True)
    return found.withColumnRenamed("id", "page_id")


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and likenesses of every document, and for those whose id is divisible by 100 how many rows lie
    within three bits of theirs; see ``fingerprint.against_edits`` and ``fingerprint.near_counts``."""
    rows = common.materialize(fingerprint.against_edits(common.table(spark, sf_dir, "documents")), "edits")
    counts = fingerprint.near_counts(rows.select("doc_id", "fp"), 3, 100)
    return rows.join(counts, "fp", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        simhash.as_hex(F.col("fp")).alias("fingerprint"),
        simhash.as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.when(F.col("doc_id") % 100 == 0, F.col("n_near")).alias("n_near"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict for every document; see ``rules.judge``."""
    return rules.judge(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document; see ``mixing.mix``."""
    mixed = mixing.mix(common.table(spark, sf_dir, "documents"), **MIX)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verdict of every document, every fifth of them tampered with; see ``merkle.audit``."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.audit(common.table(spark, sf_dir, "documents"), tampered, merkle.lowered(F.col("text")), **MERKLE)


def with_planted_period(doc_id: str | None, words: list) -> list:
    """The words that the query of periodic runs judges: of every tenth document the rest from some word on repeats."""
    if doc_id is None or not words:
        return words
    h = crc32(doc_id.encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, and digests of what is left without them; see ``periods.map_documents``."""

    def digest(words: list, runs: list) -> tuple:
        best = periods.strongest(runs)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        left = b" ".join(periods.collapsed(words, runs))
        return len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha256(listed.encode()).hexdigest(), sha256(left).hexdigest()

    schema = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return periods.map_documents(common.table(spark, sf_dir, "documents"), digest, schema, with_planted_period, **RUNS)


def op13_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows of greatest inner product for every vector whose id is divisible by 50; see ``pivots.top_products``."""
    vectors = common.table(spark, sf_dir, "embeddings")
    return pivots.top_products(vectors, vectors.where("vec_id % 50 = 0"), **NEAREST)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_language_id": op7_language_id,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_quality_rules": op9_quality_rules,
    "op10_source_mixing": op10_source_mixing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_pivot_search": op13_pivot_search,
}

ORACLES = {
    "op6_suffix_array_dedup": """
WITH hexed AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
sized AS (SELECT doc_id, h, length(h) // 2 AS n FROM hexed),
starts AS (SELECT doc_id, unnest(range(n - 99)) AS s FROM sized WHERE n >= 100),
windows AS (SELECT t.doc_id, t.s, md5(substr(z.h, 2 * t.s + 1, 200)) AS w FROM starts t JOIN sized z ON t.doc_id = z.doc_id),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS k FROM windows),
again AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM ranked WHERE k > 1),
runs AS (SELECT doc_id, s, sum(CASE WHEN p IS NULL OR s > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM again),
spans AS (SELECT doc_id, r, min(s) AS a, max(s) + 100 AS b FROM runs GROUP BY doc_id, r),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
lost AS (SELECT g.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last_b, string_agg(substr(z.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM gaps g JOIN sized z ON g.doc_id = z.doc_id GROUP BY g.doc_id)
SELECT z.doc_id, z.n AS n_bytes, coalesce(l.n_removed, 0)::BIGINT AS n_removed, coalesce(l.n_spans, 0)::BIGINT AS n_spans,
       sha256(from_hex(CASE WHEN l.doc_id IS NULL THEN z.h ELSE l.kept || substr(z.h, 2 * l.last_b + 1) END)) AS kept_sha256
FROM sized z LEFT JOIN lost l ON z.doc_id = l.doc_id
""",
    "op1_line_dedup": """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents
), line AS (
  SELECT doc_id, n AS line_no, translate(regexp_replace(all_lines[n + 1], '[^\\x20\\x09-\\x0D]*[0-9][^\\x20\\x09-\\x0D]*', '<*>', 'g'), chr(9) || chr(11) || chr(12) || chr(13), '    ') AS h
  FROM (SELECT doc_id, all_lines, unnest(range(len(all_lines))) AS n FROM split)
), token AS (
  SELECT doc_id, line_no, h, list_filter(string_split(h, ' '), lambda t: t <> '') AS tokens FROM line
), masked AS (
  SELECT doc_id, line_no, h, len(tokens)::VARCHAR || ' ' || array_to_string(tokens[1:3], ' ') AS leaf FROM token WHERE len(tokens) > 0
), pairs AS (SELECT DISTINCT doc_id, leaf, h FROM masked),
busy AS (SELECT leaf FROM pairs GROUP BY leaf HAVING count(*) >= 5),
known AS (SELECT leaf, h, count(*) AS docs, list_filter(string_split(h, ' '), lambda t: t <> '') AS tokens FROM pairs WHERE leaf IN (SELECT leaf FROM busy) GROUP BY leaf, h),
cells AS (SELECT leaf, h, docs, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM known),
constant AS (SELECT leaf, pos, token FROM cells WHERE token <> '<*>' GROUP BY leaf, pos, token HAVING sum(docs) >= 5),
seen AS (SELECT c.leaf, c.h, c.pos, CASE WHEN k.token IS NULL THEN '<*>' ELSE c.token END AS token, CASE WHEN c.token <> '<*>' THEN (k.token IS NOT NULL)::INT END AS fixed FROM cells c LEFT JOIN constant k ON c.leaf = k.leaf AND c.pos = k.pos AND c.token = k.token),
built AS (SELECT leaf, h, string_agg(token, ' ' ORDER BY pos) AS template, avg(fixed) AS share FROM seen GROUP BY leaf, h),
instances AS (SELECT m.doc_id, m.line_no, b.leaf || chr(1) || b.template AS template FROM masked m JOIN built b ON m.h = b.h AND m.leaf = b.leaf WHERE b.share >= 0.75),
counted AS (SELECT template, min(doc_id) AS first_doc FROM instances GROUP BY template HAVING count(DISTINCT doc_id) >= 5),
dropped AS (SELECT DISTINCT i.doc_id, i.line_no FROM instances i JOIN counted c ON i.template = c.template WHERE i.doc_id <> c.first_doc),
lost AS (SELECT doc_id, list(line_no) AS gone FROM dropped GROUP BY doc_id)
SELECT s.doc_id, len(all_lines)::INT AS n_lines, coalesce(len(gone), 0)::INT AS n_dropped,
       coalesce(array_to_string(list_filter(all_lines, lambda x, i: NOT list_contains(coalesce(gone, []), i - 1)), chr(10)), '') AS text
FROM split s LEFT JOIN lost l ON s.doc_id = l.doc_id
""",
    "op13_pivot_search": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.v, x.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM whole q JOIN whole x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id
)
SELECT query_id, (row_number() OVER o)::INT AS rank, vec_id, score FROM pairs WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER o <= 5
""",
    "op10_source_mixing": """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS total,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight FROM per
), levels AS (
  SELECT (1.5::DOUBLE * a.total - (SELECT coalesce(sum(b.cap), 0) FROM weighted b WHERE b.cap / b.weight < a.cap / a.weight))
         / (SELECT sum(b.weight) FROM weighted b WHERE b.cap / b.weight >= a.cap / a.weight) AS level, a.cap / a.weight AS ratio FROM weighted a
), filled AS (SELECT coalesce(arg_min(level, ratio) FILTER (WHERE level <= ratio), max(ratio)) AS level FROM levels),
targets AS (SELECT source, source_size, least(cap, weight * (SELECT level FROM filled)) AS target FROM weighted),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('20240229:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
""",
}



_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: crc32 of doc_id's digits, bit by bit: eight steps a byte.
_CRC = [
    "ids AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)",
    "crc AS (SELECT doc_id, 1 AS i, 4294967295::BIGINT AS c FROM ids UNION ALL SELECT doc_id, i + 1, list_reduce([xor(c, ascii(substr(doc_id::VARCHAR, i, 1)))::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) FROM crc WHERE i <= length(doc_id::VARCHAR))",
    "crcs AS (SELECT doc_id, xor(c, 4294967295) AS crc FROM crc WHERE i = length(doc_id::VARCHAR) + 1)",
]


def _merkle_sql(fanout: int, depth: int = 6) -> str:
    """SQL of ``merkle.audit``: ``depth`` levels of sources and of the sources' roots, enough for fanout^depth rows of each."""
    fields = "doc_id::VARCHAR, source, lang, n_chars::VARCHAR, {text}".split(", ")
    hashed = "sha256(" + " || ".join(f"coalesce(octet_length(encode({f}))::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"
    parts = [
        *_CRC,
        "hit AS (SELECT doc_id AS of, crc % 5 = 0 AS hit FROM crcs)",
        f"leaves AS (SELECT d.doc_id, source, {hashed.format(text='text')} AS h, CASE WHEN hit THEN {hashed.format(text=_LOWERED)} ELSE {hashed.format(text='text')} END AS claimed FROM documents d LEFT JOIN hit ON d.doc_id = hit.of)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, coalesce('s' || source, '') AS grp FROM leaves)",
    ]

    def level(name: str, i: int) -> list[str]:
        return [
            f"{name}r{i} AS (SELECT grp, idx // {fanout} AS g, list(h ORDER BY idx) AS run, (SELECT max(idx) FROM {name}{i} y WHERE y.grp = x.grp) > 0 AS more FROM {name}{i} x GROUP BY grp, g)",
            f"{name}{i + 1} AS (SELECT grp, g AS idx, CASE WHEN more THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM {name}r{i})",
        ]

    def climb(name: str, i: int, frm: str, to: str) -> str:
        at = f"(pos % {fanout})::INT"
        return (
            f"{to} AS (SELECT w.* EXCLUDE (folded, proof, pos), CASE WHEN more THEN sha256(array_to_string(run[1:{at}], '') || folded || array_to_string(run[{at} + 2:], '')) ELSE folded END AS folded, "
            f"CASE WHEN more THEN proof || array_to_string(run[1:{at}], '') || array_to_string(run[{at} + 2:], '') ELSE proof END AS proof, pos // {fanout} AS pos FROM {frm} w JOIN {name}r{i} r ON w.grp = r.grp AND w.pos // {fanout} = r.g)"
        )

    for i in range(depth):
        parts += level("a", i)
    parts.append(f"b0 AS (SELECT '' AS grp, row_number() OVER (ORDER BY a.grp) - 1 AS idx, a.h, a.grp AS of FROM a{depth} a)")
    for i in range(depth):
        parts += level("b", i)
    parts.append("w0 AS (SELECT doc_id, h AS leaf, grp, claimed AS folded, '' AS proof, idx AS pos FROM a0)")
    for i in range(depth):
        parts.append(climb("a", i, f"w{i}", f"w{i + 1}"))
    parts.append(f"v0 AS (SELECT w.doc_id, leaf, b.h AS subroot, '' AS grp, folded, proof, b.idx AS pos FROM w{depth} w JOIN b0 b ON w.grp = b.of)")
    for i in range(depth):
        parts.append(climb("b", i, f"v{i}", f"v{i + 1}"))
    return "WITH RECURSIVE " + ",\n".join(parts) + f"\nSELECT v.doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.h AS verified FROM v{depth} v CROSS JOIN b{depth} t"


#: Runs by self-join: words q apart are equal from i on for five words at least just where two equal 5-grams begin q apart.
_RUNS_SQL = "WITH RECURSIVE " + ", ".join(_CRC) + r""",
given AS (SELECT d.doc_id, crc, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents d LEFT JOIN crcs c ON d.doc_id = c.doc_id),
placed AS (SELECT doc_id, ws, len(ws) AS n, CASE WHEN crc % 10 = 0 AND len(ws) > 0 THEN (crc // 10) % len(ws) END AS a, 3 + (crc // 10) % 8 AS parts FROM given),
word AS (
  SELECT doc_id, n, i, CASE WHEN i >= a THEN ws[a + (i - a) % (1 + (n - a) // parts) + 1] ELSE ws[i + 1] END AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM placed)
),
gram AS (SELECT doc_id, n, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT * FROM gram WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM again x JOIN again y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS r FROM pairs),
stretches AS (SELECT doc_id, min(i) AS s, count(*) + 4 + q AS l, q FROM islands GROUP BY doc_id, q, r),
runs AS (SELECT doc_id, s, l, min(q) AS q FROM stretches WHERE l >= greatest(6, 4 * q) GROUP BY doc_id, s, l),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / q DESC, s, q) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT w.doc_id, string_agg(w, ' ' ORDER BY w.i) AS t FROM word w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i WHERE g.i IS NULL GROUP BY w.doc_id)
SELECT p.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.l // b.q)::BIGINT AS exponent_milli,
       sha256(coalesce(l.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM placed p LEFT JOIN best b ON p.doc_id = b.doc_id LEFT JOIN listed l ON p.doc_id = l.doc_id LEFT JOIN kept k ON p.doc_id = k.doc_id
"""


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return ORACLES | {"op11_merkle_manifest": _merkle_sql(MERKLE["fanout"]), "op12_periodic_runs": _RUNS_SQL}
