import hypothesis.strategies as st
import numpy as np
from hypothesis import given, settings

from pelagos.llm import suffixes


def brute(rows, length):
    """(n_bytes, n_removed, n_spans, kept) by doc_id, looking every string up in a set."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            x = data[s : s + length]
            if x in seen:
                gone[s : s + length] = True
            seen.add(x)
        spans = int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out[doc_id] = (len(data), int(gone.sum()), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


def got(df, length=100):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df, length).collect()}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=40), min_size=1, max_size=6))
def test_suffix_array_orders_suffixes(parts):
    text = np.frombuffer(b"\0".join(p.encode() for p in parts) + b"\0" + bytes(8), np.uint8).copy()
    order = suffixes.suffix_array(text, 48)
    assert sorted(order.tolist()) == list(range(len(text) - 8))
    body = text[:-8].tobytes()
    keys = [body[i : body.index(0, i)] for i in order]
    assert keys == sorted(keys)
    lcp = suffixes.common_prefixes(text, order, 16)
    raw = text.tobytes()
    for a, b, n in zip(order, order[1:], lcp[1:], strict=False):
        same = next((k for k in range(16) if raw[a + k : a + k + 1] != raw[b + k : b + k + 1]), 16)
        assert n == same or min(a, b) + 16 > len(raw) - 8


def test_matches_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert got(documents) == brute(rows, 100)


def test_low_complexity_and_hot_strings(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 4)
    monkeypatch.setattr(suffixes, "BLOCK", 500)
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, cut = noise(140), noise(90)
    rows = [(i, noise(60) + passage + noise(50)) for i in range(40)]
    rows += [(100, "a" * 900), (101, "b" * 50 + "a" * 300), (102, "ab" * 300), (103, ("abc" * 40 + "\n") * 9), (104, cut + "x" + cut), (105, "é" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for key in ("HOT", "BLOCK"):
        assert got(df) == brute(rows, 100), key
        monkeypatch.undo()


def test_awkward_rows(awkward, nothing):
    rows = suffixes.remove_repeats(awkward, 100).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].n_bytes == by[3].n_bytes == 0 and by[1].n_removed == 0
    assert (by[5].n_bytes, by[5].n_removed, by[5].n_spans, bytes(by[5].kept)) == (15000, 14995, 1, b"word ")
    assert suffixes.remove_repeats(nothing, 100).count() == 0
