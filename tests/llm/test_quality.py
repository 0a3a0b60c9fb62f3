import math
import re
import zlib

import numpy as np

from pelagos.llm import quality


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean(np.greater.outer(good, bad)) > 0.9
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.85
    assert 0.7 < model[1] < 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_only_labels_that_are_not_held_out_matter(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn("quality", quality.F.when(quality.fold(quality.F.col("doc_id")) == 1, 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = (quality.score(documents, quality.fit(documents, x)).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


def test_the_prior_and_the_risk_find_the_positives():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, (800, 3))
    unlabelled = np.concatenate((rng.normal(2, 1, (600, 3)), rng.normal(-2, 1, (400, 3))))
    net, prior = quality.train(positive, unlabelled)
    assert 0.5 < prior < 0.75
    assert np.mean(net.score(rng.normal(2, 1, (500, 3))) >= 0.5) > 0.9 and np.mean(net.score(rng.normal(-2, 1, (500, 3))) < 0.5) > 0.9


def test_awkward_rows(awkward, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, 1), (5, 0), (6, None)], "doc_id long, quality int")
    rows = quality.score(awkward, quality.fit(awkward, labels)).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.fit(nothing, labels) is None and quality.score(nothing, None).count() == 0
    assert {r.score for r in quality.score(awkward, None).collect()} == {0.5}


def plain_features(text):
    """The features one by one, as sums over characters, words and lines."""
    kinds = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>", "|", "!?", ".,;:", "'\"()-", "{}[]=_/\\@+~^`"]
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, size = len(words), max(1, sum(len(w) for w in words))
    own = len(set(words))
    return [math.asinh(50 * sum(c in k for c in text) / size) for k in kinds] + [
        math.log(1 + n), size / max(1, n) / 5, math.log(1 + len(lines)), math.log(1 + n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), own / max(1, n),
        math.log(1 + own) / max(1.0, math.log(1 + n)), sum(words[i] == words[i - 1] for i in range(1, n)) / max(1, n), sum(w[-1:] in (b".", b"!", b"?", b":", b";") for w in words) / max(1, n),
    ]


def test_features_against_plain_counts(documents):
    texts = [r.text or "" for r in documents.collect()] + ["", " \n\t", "Ünï | # A a a. a! é\n\n\nx x", "a\r\nb\r\n", "Wort und Zahl 12. " * 600_000]
    for t in texts:
        assert quality.features(t) == [quality.np.float64(x) for x in plain_features(t)] or np.allclose(quality.features(t), plain_features(t), rtol=1e-12, atol=1e-12)


def test_gradients_against_differences():
    """Of both parts of the risk: what a step adds up is the slope of the loss in every weight."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (40, 4))
    net = quality.Network(x.mean(axis=0), x.std(axis=0), 3, 2)
    for sign in (1, -1):
        loss = lambda: float(np.logaddexp(0, -sign * net.forward(x)[2]).mean())
        z, h, f = net.forward(x)
        slope = (quality.sigmoid(f) - 1 if sign == 1 else quality.sigmoid(f)) / len(x)
        for w, g in zip(net.weights, net.gradient(z, h, slope), strict=True):
            for at in np.ndindex(w.shape):
                kept = w[at]
                w[at] = kept + 1e-6
                up = loss()
                w[at] = kept - 1e-6
                down = loss()
                w[at] = kept
                assert abs((up - down) / 2e-6 - g[at]) < 1e-6


def test_the_risk_of_the_negatives_stays_above_zero():
    """Trained long on few rows, an unclipped risk of the negatives would fall far below zero."""
    rng = np.random.default_rng(7)
    positive, unlabelled = rng.normal(0.5, 1, (60, 6)), np.concatenate((rng.normal(0.5, 1, (40, 6)), rng.normal(-0.5, 1, (20, 6))))
    net, prior = quality.train(positive, unlabelled, steps=3000)
    negative = np.logaddexp(0, net.forward(unlabelled)[2]).mean() - prior * np.logaddexp(0, net.forward(positive)[2]).mean()
    assert negative > -0.05
