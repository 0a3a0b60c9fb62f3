"""Quality scores by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled good; everything else is unlabelled web text of either kind. The share of
good text in it (the class prior) is estimated from how many of either pass the same threshold. A small network then minimises the non-negative unbiased risk
prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)]).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes counted as one kind each.
KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b"!?", b".,;:", b"'\"()-", b"{}[]=_/\\@+~^`")
#: Kind of each byte; 0 for the rest.
KIND = np.array([next((i + 1 for i, k in enumerate(KINDS) if b in k), 0) for b in range(256)], np.uint8)
N_FEATURES = len(KINDS) + 9


def features(text: str) -> list[float]:
    """Statistics of a whole text. None depends on anything but the text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, size = len(words), max(1, sum(map(len, words)))
    kinds = np.bincount(KIND[np.frombuffer(data, np.uint8)], minlength=len(KINDS) + 1)[1:] if data else np.zeros(len(KINDS))
    ends = sum(w[-1:] in b".!?:;" for w in words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    own = len(set(words))
    return [
        *np.arcsinh(kinds / size * 50).tolist(),
        np.log1p(n),
        size / max(1, n) / 5,
        np.log1p(len(lines)),
        np.log1p(n / max(1, len(lines))),
        len(set(lines)) / max(1, len(lines)),
        own / max(1, n),
        np.log1p(own) / max(1.0, np.log1p(n)),
        same / max(1, n),
        ends / max(1, n),
    ]


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(x.as_py() or "") for x in batch.column(0)]
        yield pa.record_batch([pa.array(rows, pa.list_(pa.float64())), *batch.columns[1:]], ["x", *batch.schema.names[1:]])


class Network:
    """One hidden layer on standardised features; plain numpy, so it travels with the job."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.weights = [rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        h = np.tanh(z @ self.weights[0] + self.weights[1])
        return z, h, h @ self.weights[2] + self.weights[3]

    def gradient(self, z: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        back = g[:, None] * self.weights[2] * (1 - h * h)
        return [z.T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.forward(x)[2])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _descend(net: Network, step, steps: int, rate: float) -> None:
    """Adam; ``step`` gives the gradients of each step."""
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    for t in range(1, steps + 1):
        for w, g, m, v in zip(net.weights, step(), first, second, strict=True):
            g = g + 1e-4 * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, hidden: int, seed: int) -> float:
    """Share of positives among the unlabelled, from a classifier of positive against unlabelled rows.

    Above any threshold lie a share q_p of the positives and a share q_u >= prior * q_p of the unlabelled, with
    equality where no negative lies above it; so the least q_u / q_p is the estimate. The classifier is fitted on one
    half of the rows and the shares are counted on the other, over thresholds that most positives pass. The estimate
    is lowered by three hundredths of itself: one that is too high makes the risk of the negatives vanish before they
    are learnt, one that is a little too low costs next to nothing.
    """
    rng = np.random.default_rng(seed)
    p, u = rng.permutation(positive), rng.permutation(unlabelled)
    fit_p, held_p, fit_u, held_u = p[::2], p[1::2], u[::2], u[1::2]
    if not len(held_p) or not len(held_u):
        return 0.5
    every = np.concatenate((fit_p, fit_u))
    net = Network(every.mean(axis=0), every.std(axis=0) + 1e-3, hidden, seed)

    def step():
        a, b = fit_p[rng.integers(0, len(fit_p), 256)], fit_u[rng.integers(0, len(fit_u), 256)]
        z, h, f = net.forward(np.concatenate((a, b)))
        return net.gradient(z, h, (sigmoid(f) - np.repeat([1.0, 0.0], 256)) / 512)

    _descend(net, step, 400, 0.01)
    own, other = np.sort(net.forward(held_p)[2]), np.sort(net.forward(held_u)[2])
    thresholds = own[: max(1, len(own) // 3)]
    q_p = 1 - np.searchsorted(own, thresholds) / len(own)
    q_u = 1 - np.searchsorted(other, thresholds) / len(other)
    return float(np.clip(0.97 * (q_u / q_p).min(), 0.05, 0.97))


def train(positive: np.ndarray, unlabelled: np.ndarray, hidden: int = 16, steps: int = 1200, seed: int = 11) -> tuple[Network, float]:
    """The network of least non-negative risk and the class prior it was found with."""
    prior = class_prior(positive, unlabelled, hidden, seed)
    every = np.concatenate((positive, unlabelled))
    net = Network(every.mean(axis=0), every.std(axis=0) + 1e-3, hidden, seed)
    rng = np.random.default_rng(seed + 1)
    size = 512

    def step():
        a, b = positive[rng.integers(0, len(positive), size)], unlabelled[rng.integers(0, len(unlabelled), size)]
        za, ha, fa = net.forward(a)
        zb, hb, fb = net.forward(b)
        # Logistic loss l(f) = ln(1 + exp(-f)); l'(f) = sigmoid(f) - 1 and l(-f)' = sigmoid(f).
        negative = np.logaddexp(0, fb).mean() - prior * np.logaddexp(0, fa).mean()
        other = [x - prior * y for x, y in zip(net.gradient(zb, hb, sigmoid(fb) / size), net.gradient(za, ha, sigmoid(fa) / size), strict=True)]
        if negative < 0:  # below zero the risk of the negatives is over-fitted: go back
            return [-x for x in other]
        own = net.gradient(za, ha, prior * (sigmoid(fa) - 1) / size)
        return [x + y for x, y in zip(own, other, strict=True)]

    _descend(net, step, steps, 0.005)
    return net, prior


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3; rows of remainder 1 are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, positives: int = 8000, unlabelled: int = 8000) -> tuple[Network, float] | None:
    """Fit on rows that are not held out: at most ``positives`` rows labelled good (first by a hash of their id) and
    about ``unlabelled`` rows of any kind, labels unread. None if there is no positive or no unlabelled row."""
    learn = fold(F.col("doc_id")) != 1
    good = labels.where(learn).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).withColumn("__good", F.lit(True))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(learn)
    share = min(1.0, unlabelled / max(1, docs.select("doc_id").where(learn).count()))
    drawn = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "text", F.lit(13)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    # At most ``positives`` ids are broadcast.
    marked = rows.join(F.broadcast(chosen), "doc_id", "left").select("text", F.coalesce("__good", F.lit(False)).alias("good"), drawn.alias("drawn"))
    # One id or text may be most rows: equal rows of the sample are one, with a count, and weigh as many.
    sample = marked.where("good or drawn").distinct().mapInArrow(_featurize, "x array<double>, good boolean, drawn boolean").toPandas()
    stacked = np.array(sample["x"].tolist(), np.float64).reshape(-1, N_FEATURES)
    order = np.lexsort(stacked.T)
    stacked, good_rows, drawn_rows = stacked[order], sample["good"].to_numpy(bool)[order], sample["drawn"].to_numpy(bool)[order]
    if not good_rows.any() or not drawn_rows.any():
        return None
    return train(stacked[good_rows], stacked[drawn_rows])


def score(docs: DataFrame, model: tuple[Network, float] | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs(doc_id, text)``; score from 0 to 1, higher for good text.

    Null and empty texts have a score as well (that of a text without words); without a model every score is 0.5.
    Other columns are never read; repeated rows score alike; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py() or "") for t in batch.column(2)], np.float64).reshape(-1, N_FEATURES)
            scores = model[0].score(x) if model else np.full(len(x), 0.5)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
