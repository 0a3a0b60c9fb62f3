import numpy as np
from pyspark.sql import functions as F

from pelagos.llm import language


def table(spark, name, sf="0.01"):
    return spark.read.parquet(f"/root/testdata/sf{sf}/{name}.parquet")


def test_pages_are_identified_as_declared(spark):
    model = language.fit(table(spark, "documents"))
    pages = table(spark, "pages")
    found = language.identify(language.page_evidence(pages), model, markup=True)
    rows = found.join(language.page_evidence(pages).select("id", "declared"), "id").collect()
    assert len(rows) == pages.count()
    assert np.mean([r.lang == r.declared for r in rows]) > 0.97


def test_documents_are_kept_with_their_language(spark):
    docs = table(spark, "documents")
    out = language.with_language(docs)
    assert out.columns == docs.columns
    both = out.select("doc_id", F.col("lang").alias("found")).join(docs, "doc_id")
    assert out.count() >= 0.99 * docs.count()
    assert both.where("found = lang").count() >= 0.97 * docs.count()


def test_scores_match_a_plain_sum(spark, documents):
    langs, table = language.fit(documents)
    rows = documents.selectExpr("doc_id id", "text", "cast(null as string) declared", "cast(null as string) suffix", "cast(null as string) host", "cast(null as string) domain")
    got = {r.id: r for r in language.identify(rows, (langs, table)).collect()}
    for r in documents.collect():
        letters = "".join(c if not c.isascii() else c.lower() if c.isalpha() else " " for c in r.text)
        data = (" " + " ".join(x for x in letters.split(" ") if x) + " ").encode()
        sums = np.zeros(len(langs))
        for i in range(len(data) - 2):
            x = data[i] << 16 | data[i + 1] << 8 | data[i + 2]
            sums += table[:, (x * 2654435761 % 2**32) >> 17]
        assert got[r.doc_id].text_lang == langs[int(np.argmax(sums))]


def test_weak_texts_follow_the_other_evidence(spark):
    model = language.fit(table(spark, "documents"))
    german = [r.text for r in table(spark, "documents").where("lang = 'de'").limit(12).collect()]
    rows = [(i, t, "de", "org", "a.example.org", "example.org") for i, t in enumerate(german)] + [(100, "in", "de", "org", "a.example.org", "example.org"), (101, "in", None, None, None, None)]
    got = {r.id: r for r in language.identify(spark.createDataFrame(rows, "id long, text string, declared string, suffix string, host string, domain string"), model).collect()}
    assert got[100].lang == "de" and got[100].confidence > 0.8


def test_awkward_rows(awkward, nothing, spark):
    out = language.with_language(awkward, 100)
    assert out.columns == awkward.columns
    assert out.where("text is null or trim(text) = ''").count() == 0
    assert language.with_language(nothing).count() == 0
    pages = spark.createDataFrame([(1, None, None), (2, "not a url", "<p>text"), (3, "http://h", ""), (None, "HTTPS://u:p@A.B.example.COM:80/x?y#z", "<HTML LANG=EN-us>hi")], "page_id long, url string, html string")
    rows = language.page_evidence(pages).orderBy("id").collect()
    assert (rows[0].declared, rows[0].suffix, rows[0].host, rows[0].domain) == ("en", "com", "a.b.example.com", "example.com")
    assert language.identify(language.page_evidence(pages), ([], np.zeros((0, language.BUCKETS))), True).count() == 4
    assert language.identify(language.page_evidence(pages), language.fit(table(spark, "documents", "0.001")), True).count() == 4
