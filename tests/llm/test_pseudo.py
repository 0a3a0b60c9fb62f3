import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagos.llm import common, pseudo


def plain_tokens(text):
    data = (text or "").encode()
    lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    return re.findall(rb"[.,;:!?]|[^\x20\x09-\x0D.,;:!?]+", lowered)


def plain_hash(token):
    value = sum((b + 1) * pow(pseudo.ODD, i, 1 << 64) for i, b in enumerate(token)) % (1 << 64)
    value ^= value >> 32
    return (value * 0xBF58476D1CE4E5B9 % (1 << 64)) >> 32


def test_token_hashes_match_a_plain_split(documents, monkeypatch):
    texts = [r.text for r in documents.limit(60).collect()] + ["", None, " ", "a", "A.b,,C !?", "Ünï çødé.", "\n\t x\x0b\x0cy\r", "x" * 900, "end."]
    want = [[plain_hash(t) for t in plain_tokens(x)] for x in texts]
    data = [(x or "").encode() for x in texts]
    for piece in (1 << 18, 700):
        monkeypatch.setattr(pseudo, "PIECE", piece)
        assert [np.frombuffer(x, "<u4").tolist() for x in pseudo.hashes_of(data)] == want


def test_counts_and_classes_match_a_counter(documents, monkeypatch):
    monkeypatch.setattr(pseudo, "WORDS", 50)
    hashed = common.materialize(pseudo.hashed_tokens(documents), "hashed")
    known = pseudo.classes(pseudo.word_counts(hashed))
    want = Counter(plain_hash(t) for r in documents.collect() for t in plain_tokens(r.text))
    top = sorted(want, key=lambda h: (-want[h], h))[:50]
    assert known.of(np.array(top, np.uint32)).tolist() == list(range(1, 51))
    counts = np.zeros(pseudo.CLASSES, np.int64)
    for h, n in want.items():
        counts[top.index(h) + 1 if h in top else pseudo.CLASSES - pseudo.HASHED + h % pseudo.HASHED] += n
    assert (known.counts == counts).all()
    ids = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in pseudo.encode(hashed, known).collect()}
    for r in documents.limit(20).collect():
        assert ids[r.doc_id] == [top.index(h) + 1 if h in top else pseudo.CLASSES - pseudo.HASHED + h % pseudo.HASHED for h in map(plain_hash, plain_tokens(r.text))]


@pytest.fixture
def some():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 1000, pseudo.CLASSES)
    texts = [rng.integers(1, pseudo.CLASSES, n).astype("<u2").tobytes() for n in (50, 0, 1, 30)]
    weights = [w + rng.normal(0, 0.1, w.shape).astype(np.float32) for w in pseudo.initial(counts)]
    return weights, texts


def plain_log_probabilities(weights, ids):
    """Two plain softmaxes per token."""
    around = [0, 0, *ids, 0, 0]
    out = []
    for i, own in enumerate(ids):
        h = np.maximum(weights[1] + sum(weights[0][k][around[i + 2 + s]] for k, s in enumerate(pseudo.SIDES)), 0).astype(float)
        group, inner = own // pseudo.PER_GROUP, own % pseudo.PER_GROUP
        one = weights[2] @ h + weights[3]
        two = weights[4][group] @ h + weights[5][group]
        out.append(one[group] - np.logaddexp.reduce(one) + two[inner] - np.logaddexp.reduce(two))
    return out


def test_log_probabilities_match_plain_softmaxes(some):
    weights, texts = some
    got = pseudo.log_probabilities(weights, *pseudo.padded(texts))
    want = [x for t in texts for x in plain_log_probabilities(weights, np.frombuffer(t, "<u2").tolist())]
    assert np.allclose(got, want, atol=1e-3)


def test_all_classes_sum_to_one(some):
    weights, _ = some
    rows = [np.array([x], "<u2").tobytes() for x in range(1, pseudo.CLASSES)]
    first = plain_log_probabilities(weights, [0])
    assert abs(np.exp(pseudo.log_probabilities(weights, *pseudo.padded(rows))).sum() + np.exp(first[0]) - 1) < 1e-3


def test_gradients_match_differences(some):
    weights, texts = some
    weights = [w.astype(np.float64) for w in weights]
    row, at = pseudo.padded(texts)
    loss = lambda: -pseudo.log_probabilities(weights, row, at).sum()
    full = [np.zeros(w.shape) for w in weights]
    for which, where, g in pseudo.gradients(weights, row, at):
        full[which][where] += g
    rng = np.random.default_rng(3)
    for which, g in enumerate(full):
        for place in rng.permutation(np.argwhere(g != 0))[:8]:
            place = tuple(place)
            old = weights[which][place]
            weights[which][place] = old + 1e-5
            up = loss()
            weights[which][place] = old - 1e-5
            down = loss()
            weights[which][place] = old
            assert abs((up - down) / 2e-5 - g[place]) < 1e-3 + 1e-3 * abs(g[place])


def test_one_step_of_descent_is_adagrad(some):
    weights, texts = some
    row, at = pseudo.padded(texts)
    full = [np.zeros(w.shape) for w in weights]
    for which, where, g in pseudo.gradients(weights, row, at):
        full[which][where] += g
    want = [w - 0.1 * g / np.sqrt(1 + g * g) for w, g in zip(weights, full, strict=True)]
    moved = [w.copy() for w in weights]
    pseudo.descend(moved, [np.ones(w.shape, np.float32) for w in weights], row, at, 0.1)
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(moved, want, strict=True))


def trained(docs, rounds=1):
    hashed = common.materialize(pseudo.hashed_tokens(docs), "hashed")
    known = pseudo.classes(pseudo.word_counts(hashed))
    encoded = common.materialize(pseudo.encode(hashed, known), "encoded")
    return encoded, known, pseudo.fit(encoded, known.counts, rounds=rounds)


def test_shards_are_averaged_by_tokens(documents, monkeypatch):
    monkeypatch.setattr(pseudo, "SHARD_LEAST", 20_000)
    encoded, known, weights = trained(documents)
    shards = pseudo.shards_of(int(known.counts.sum()))
    assert shards > 1
    mixed = F.xxhash64("doc_id", "ids")
    rows = encoded.select(F.pmod(mixed, F.lit(shards)).alias("shard"), mixed.alias("mixed"), "ids").orderBy("shard", "mixed").collect()
    total, seen = 0, 0
    for shard in range(shards):
        own = [w.copy() for w in pseudo.initial(known.counts)]
        row, at = pseudo.padded([bytes(r.ids) for r in rows if r.shard == shard])
        pseudo.descend(own, [np.ones(w.shape, np.float32) for w in own], row, at, 0.1)
        total, seen = total + pseudo._flat(own).astype(float) * len(at), seen + len(at)
    assert seen == known.counts.sum()
    assert np.allclose(pseudo._flat(weights), total / seen, atol=1e-5)


def test_layouts_agree(documents):
    key = lambda df: {r.doc_id: r.mean_log_probability for r in pseudo.pseudo_likelihood(df).collect()}
    one, two = key(documents), key(documents.repartition(7))
    assert one.keys() == two.keys() and all(one[d] == two[d] or abs(one[d] - two[d]) < 1e-6 for d in one)


def grammar(n, seed):
    """Texts in which each word has two that may follow it."""
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i // 6)}{chr(97 + i % 6)}" for i in range(36)]
    out = []
    for _ in range(n):
        at, text = int(rng.integers(36)), []
        for _ in range(200):
            text.append(words[at])
            at = (at * 5 + 1 + int(rng.integers(2))) % 36
        out.append(" ".join(text))
    return out


def test_shuffled_words_score_lower(spark, monkeypatch):
    monkeypatch.setattr(pseudo, "BATCH", 512)
    docs = spark.createDataFrame(list(enumerate(grammar(400, 1))), "doc_id long, text string")
    encoded, _, weights = trained(docs, rounds=2)
    rng = np.random.default_rng(0)
    lower = []
    for r in encoded.limit(100).collect():
        ids = np.frombuffer(r.ids, "<u2")
        score = lambda x: pseudo.log_probabilities(weights, *pseudo.padded([x.tobytes()])).sum()
        lower.append(score(ids) > score(rng.permutation(ids)))
    assert np.mean(lower) > 0.9


def test_training_helps_and_counts_are_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    encoded, known, weights = trained(docs)
    rows = {r.doc_id: r for r in pseudo.score(encoded, weights).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(rows[d].n_tokens == len(plain_tokens(t)) for d, t in texts.items())
    mean = np.average([r.mean_log_probability for r in rows.values()], weights=[r.n_tokens for r in rows.values()])
    start = pseudo.score(encoded, pseudo.initial(known.counts)).selectExpr("sum(pseudo_log_likelihood) / sum(n_tokens) m").first().m
    assert mean > start + 0.3


def test_awkward_rows(awkward, nothing):
    rows = {r.doc_id: r for r in pseudo.pseudo_likelihood(awkward, 1).collect()}
    assert rows[2].n_tokens == rows[3].n_tokens == 0 and rows[2].pseudo_log_likelihood == 0 and rows[2].mean_log_probability is None
    assert rows[5].n_tokens == 3000
    assert pseudo.pseudo_likelihood(nothing).count() == 0
