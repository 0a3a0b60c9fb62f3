"""Language identification by Bayesian evidence fusion.

For each language the log-likelihood of the text, the likelihoods of the declared markup language and of the
address suffix, and a prior of the host are added up. Text likelihoods are those of hashed byte trigrams; the
other tables are grouped sums of what the texts alone say, over all rows, each row's own share left out of its
host's prior. Host priors are smoothed by those of their domain, and these by the prior of all rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.llm import common

#: Hash buckets of the byte trigrams.
BUCKETS = 1 << 15
#: Text log-likelihoods count this much, since neighbouring trigrams share bytes.
TEMPER = 0.3
#: Rows' worth of the wider prior in a host's and a domain's prior, and of a flat one in the likelihood tables.
SMOOTH = 2.0
#: Parts of a page that are not its text.
MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b"


def visible(page: str) -> str:
    """The text of a page: scripts, styles, comments and tags out, character references resolved."""
    return html.unescape(MARKUP.sub(" ", page))


#: A-Z to a-z, every other ASCII byte that is no letter to a blank: digits, marks and symbols are of no language.
LETTERS = bytes(b if b > 127 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def trigrams(text: str) -> np.ndarray:
    """Buckets of all byte trigrams of the letters of ``text``, each run of anything else between them one blank."""
    data = np.frombuffer(b" %b " % b" ".join(text.encode("utf-8", "surrogatepass").translate(LETTERS).split()), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    return ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)) >> np.uint32(17)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: labelled texts ``(lang, text)`` to trigram counts by language, summed over the batch."""
    for batch in batches:
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[:] += np.bincount(trigrams(text.as_py() or ""), minlength=BUCKETS)
        for lang, x in sums.items():
            at = np.flatnonzero(x)
            if len(at):
                yield pa.record_batch([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(x[at])], ["lang", "bucket", "n"])


def fit(labelled: DataFrame, per_language: int = 1000, most: int = 1000) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram log-probabilities, from about ``per_language`` rows of each ``lang`` of
    ``labelled(doc_id, text, lang)``.

    Rows are chosen by a hash of id and text, so the choice spreads over the table and reruns agree. Every language that
    occurs is known, however rare; more than ``most`` of them are no languages and raise an error, as the table of
    likelihoods goes to every task.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    sizes = rows.groupBy("lang").count().orderBy("lang").limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages")
    langs = [r["lang"] for r in sizes]
    if not langs:
        return [], np.zeros((0, BUCKETS))
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], int(min(1.0, per_language / r["count"]) * (1 << 20)) + 1)])
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "text"), F.lit(1 << 20))
    chosen = rows.where(draw < F.element_at(shares, F.col("lang"))).select("lang", "text")
    table = np.full((len(langs), BUCKETS), 0.1)
    place = {x: i for i, x in enumerate(langs)}
    counts = chosen.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # a number per language and bucket at most
    row = np.array([place[x] for x in got["lang"].to_pylist()], np.int64)
    np.add.at(table, (row, got["bucket"].to_numpy().astype(np.int64)), got["n"].to_numpy())
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _likelihoods(table: np.ndarray, markup: bool):
    """mapInArrow body: ``(id, text)`` to its number of trigrams and letters' presence, and mean log-likelihoods."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, means, lettered = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                grams = trigrams(visible(text) if markup else text)
                n.append(len(grams))
                lettered.append(any(c.isalpha() for c in text))
                means.append([float(row[grams].mean(dtype=np.float64)) if len(grams) else 0.0 for row in table])
            yield pa.record_batch([batch.column(0), *batch.columns[2:], pa.array(n, pa.int64()), pa.array(lettered), pa.array(means, pa.list_(pa.float64()))], ["id", *batch.schema.names[2:], "n_grams", "lettered", "means"])

    return run


def _softmax(values: list[Column]) -> list[Column]:
    top = F.greatest(*values) if len(values) > 1 else values[0]
    powers = [F.exp(v - top) for v in values]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], markup: bool = False) -> DataFrame:
    """``id, lang, confidence, text_lang, accepted`` per row of ``rows(id, text, declared, suffix, host, domain)``.

    ``lang`` has the largest posterior and ``confidence`` is that; ``text_lang`` is the choice of the text alone. A row
    is rejected (``accepted`` false, ``lang`` 'und') if it has no letter, or if its text is less likely in its language
    than if all trigrams were alike. Null texts are empty; null evidence says nothing; a host that most rows share is
    summed before the shuffle. Without any known language every row with a letter is accepted as 'und'. An empty
    table gives no rows.
    """
    langs, table = model
    evidence = ["declared", "suffix", "host", "domain"]
    base = rows.select("id", F.col("text").cast("string"), *[F.col(c).cast("string") for c in evidence])
    kind = dict(base.dtypes)["id"]
    scored = base.mapInArrow(_likelihoods(table, markup), f"id {kind}, declared string, suffix string, host string, domain string, n_grams long, lettered boolean, means array<double>")
    if not langs:
        return scored.select("id", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_lang"), F.col("lettered").alias("accepted"))
    k = range(len(langs))
    # The evidence of a text grows with the root of its length beyond some hundred trigrams: long texts repeat themselves.
    weight = TEMPER * F.least(F.col("n_grams").cast("double"), F.sqrt(F.col("n_grams") * 400.0))
    texts = [weight * F.get("means", F.lit(i)) for i in k]
    scored = scored.withColumns({f"t_{i}": t for i, t in enumerate(texts)})
    scored = common.materialize(scored.withColumns({f"p_{i}": p for i, p in enumerate(_softmax([F.col(f"t_{i}") for i in k]))}), "scores")
    informed = scored.where("n_grams > 0")
    sums = lambda key: informed.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.sum(f"p_{i}").alias(f"{key}_{i}") for i in k])
    overall = informed.agg(*[F.coalesce(F.sum(f"p_{i}"), F.lit(0.0)) for i in k]).first()
    prior = [(overall[i] + 1.0) / (sum(overall) + len(langs)) for i in k]
    joined = scored
    for key in evidence:
        joined = joined.join(sums(key), key, "left")
    own = lambda i: F.when(F.col("n_grams") > 0, F.col(f"p_{i}")).otherwise(0.0)
    rest = lambda key, i: F.greatest(F.coalesce(F.col(f"{key}_{i}"), F.lit(0.0)) - F.when(F.col(key).isNotNull(), own(i)).otherwise(0.0), F.lit(0.0))
    total = lambda key: sum((rest(key, i) for i in k if i), rest(key, 0))
    domain = [(rest("domain", i) + SMOOTH * prior[i]) / (total("domain") + SMOOTH) for i in k]
    host = [(rest("host", i) + SMOOTH * domain[i]) / (total("host") + SMOOTH) for i in k]
    # P(value | language): the value's sum over the language's, smoothed towards saying nothing.
    given = lambda key, i: F.when(
        F.col(key).isNotNull(), F.ln((rest(key, i) + SMOOTH * prior[i]) / (overall[i] + SMOOTH * len(langs)))
    ).otherwise(0.0)
    posterior = _softmax([F.col(f"t_{i}") + given("declared", i) + given("suffix", i) + F.ln(host[i]) for i in k])
    best = lambda cols: F.array_max(F.array(*[F.struct(c.alias("p"), F.lit(-i).alias("i")) for i, c in enumerate(cols)]))
    names = F.lit(langs)
    judged = joined.select("id", "lettered", "n_grams", "means", best(posterior).alias("best"), best([F.col(f"p_{i}") for i in k]).alias("text"))
    flat = -float(np.log(BUCKETS))
    accepted = F.col("lettered") & (F.col("n_grams") > 0) & (F.get("means", -F.col("best.i")) > flat)
    return judged.select(
        "id",
        F.when(accepted, F.get(names, -F.col("best.i"))).otherwise("und").alias("lang"),
        F.when(accepted, F.col("best.p")).otherwise(0.0).alias("confidence"),
        F.get(names, -F.col("text.i")).alias("text_lang"),
        F.coalesce(accepted, F.lit(False)).alias("accepted"),
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """Rows for ``identify`` from ``pages(page_id, url, html)``: what the markup declares, and the parts of the address."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = F.lower(F.regexp_extract("html", DECLARED, 1))
    named = pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"), declared.alias("declared"), host.alias("host"))
    blank = lambda c: F.when(c != "", c)
    return named.select(
        "id", "text", blank(F.col("declared")).alias("declared"),
        blank(F.regexp_extract("host", r"\.([^.]+)$", 1)).alias("suffix"),
        blank(F.col("host")).alias("host"),
        blank(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).alias("domain"),
    )


def with_language(docs: DataFrame, per_language: int = 1000) -> DataFrame:
    """``docs`` without the rows that are rejected, ``lang`` as identified. Sources stand for hosts; nothing is declared.

    Rows equal in text and source are identified alike, so they are joined back by a hash of both. Other columns are
    kept, whatever their names.
    """
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit("")))
    none = F.lit(None).cast("string")
    keyed = docs.select(key.alias("id"), common.packed(docs))
    rows = keyed.select("id", "row.text", none.alias("declared"), none.alias("suffix"), F.col("row.source").alias("host"), none.alias("domain"))
    found = identify(rows, fit(docs, per_language)).groupBy("id").agg(F.max(F.struct("confidence", "lang", "accepted")).alias("f")).where("f.accepted")
    return keyed.join(found, "id").select(*common.unpacked(docs, lang=F.col("f.lang")))
