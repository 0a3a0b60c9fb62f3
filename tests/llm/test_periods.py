import random

from pelagos.llm import periods
from pelagos.llm import queries as registered


def plain(words, least=6, times=4):
    """All runs, period by period over every start."""
    found = {}
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def listed(texts, **sizes):
    return list(periods.find([t for t in texts], **sizes))


def test_overlap_is_the_least_of_all_periods():
    assert periods.overlap(6, 4) == 5
    for least in range(2, 30):
        for times in range(2, 6):
            assert periods.overlap(least, times) == min(max(least, times * q) - q for q in range(1, 200))


def test_random_words_against_brute_force():
    random.seed(3)
    texts = []
    for k in range(400):
        alphabet = [b"a", b"b", b"c", b"d"][: 1 + k % 4]
        t = [random.choice(alphabet) for _ in range(random.randrange(60))]
        if k % 3 == 0:
            block = [random.choice(alphabet) for _ in range(random.randrange(1, 9))]
            t += block * random.randrange(2, 9) + block[: random.randrange(len(block) + 1)] + [random.choice(alphabet) for _ in range(9)]
        texts.append(t)
    assert any(plain(t) for t in texts)
    assert listed(texts) == [plain(t) for t in texts]
    for least, times in ((2, 2), (4, 2), (9, 3)):
        assert listed(texts, least=least, times=times) == [plain(t, least, times) for t in texts]


def test_whole_documents_against_brute_force(documents):
    rows = documents.collect()
    texts = [registered.with_planted_period(str(r.doc_id), periods.words(r.text)) for r in rows]
    want = [plain(t) if len(t) < 4000 else None for t in texts]
    got = listed(texts)
    assert sum(map(bool, got)) > 10
    assert all(g == w for g, w in zip(got, want, strict=True) if w is not None)


def test_masked_words_are_in_no_run():
    """Words outside repeated k-grams are dropped before the search, and nothing is lost by it."""
    import numpy as np

    random.seed(5)
    filler = [f"w{i}".encode() for i in range(500)]
    text = filler[:200] + [b"x", b"y", b"z"] * 5 + filler[200:400] + [b"s"] * 7 + filler[400:] + filler[:20]
    ids = np.unique(text, return_inverse=True)[1].astype(np.int64)
    kept = periods.repeated_grams(ids, np.zeros(len(ids), np.int64), 5)
    assert kept.sum() == 15 + 7 + 2 * 20
    assert listed([text]) == [[(200, 15, 3), (415, 7, 1)]]


def test_collapse_and_strongest():
    text = b"a b x y x y x y x y c c c c c c d".split()
    runs = plain(text)
    assert runs == [(2, 8, 2), (10, 6, 1)]
    assert b" ".join(periods.collapsed(text, runs)) == b"a b x y c d"
    assert periods.strongest(runs) == (10, 6, 1)
    assert periods.strongest([(5, 8, 2), (9, 8, 2), (1, 12, 3)]) == (5, 8, 2)
    assert periods.strongest([]) is None


def test_planted_period():
    for key in map(str, range(400)):
        words = [f"{key}-{i}" for i in range(37)]
        made = registered.with_planted_period(key, words)
        h = registered.crc32(key.encode())
        if h % 10:
            assert made == words
            continue
        g = h // 10
        a, p = g % 37, 1 + (37 - g % 37) // (3 + g % 8)
        assert made == [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_long_texts_end():
    """A text of one word, a million times over, and a long block many times: no work per period and place."""
    one = [b"w"] * 1_000_000
    block = [str(i).encode() for i in range(9_973)]
    assert listed([one, block * 30]) == [[(0, 1_000_000, 1)], [(0, 9_973 * 30, 9_973)]]


def test_rows(spark, awkward, nothing):
    rows = sorted(map(tuple, periods.runs(awkward).collect()), key=repr)
    assert len(rows) == awkward.count()
    by = {r[0]: r[1:] for r in rows}
    assert by[5] == ([0], [3000], [1], "word")
    assert by[2] == by[3] == by[4] == ([], [], [], "")
    assert by[None] == ([], [], [], "a text without an id")
    odd = next(r.text for r in awkward.collect() if r.doc_id == 6)
    assert by[6] == ([], [], [], odd)
    assert periods.runs(nothing).count() == 0
    pieces = spark.createDataFrame([(2**62 + i, "x y " * 20 + f"v{i}") for i in range(50)], "doc_id long, text string").repartition(3)
    whole = {tuple(map(str, r)) for r in periods.runs(pieces).collect()}
    assert whole == {(str(2**62 + i), "[0]", "[40]", "[2]", f"x y v{i}") for i in range(50)}
