import zlib
from itertools import product

import numpy as np
import pyarrow as pa

from pelagos.llm import packing, queries


def test_fullest_is_the_best_combination():
    rng = np.random.default_rng(3)
    for _ in range(60):
        counts = {int(n): int(rng.integers(1, 4)) for n in rng.choice(np.arange(1, 40), 4, replace=False)}
        room = int(rng.integers(0, 80))
        best = max(s for ks in product(*(range(c + 1) for c in counts.values())) if (s := sum(k * n for k, n in zip(ks, counts, strict=True))) <= room)
        chosen = packing.fullest(counts, room)
        assert sum(k * n for n, k in chosen.items()) == best and all(k <= counts[n] for n, k in chosen.items())


def check(docs, rows, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for r in docs.collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(r.doc_id, k, at, len(p), zlib.crc32(p.tobytes())) for k, at in enumerate(range(0, len(ids), capacity)) for p in [ids[at : at + capacity]]]
    key = lambda x: (x[0] is None, x)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_places_and_few_sequences(documents):
    rows = packing.pack(documents, queries.tokenizer_path(), 2048, per_group=50).collect()
    bins = check(documents, rows, 2048)
    assert len(bins) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_awkward_rows(awkward, nothing):
    rows = packing.pack(awkward, queries.tokenizer_path(), 64).collect()
    check(awkward, rows, 64)
    assert packing.pack(nothing, queries.tokenizer_path(), 64).count() == 0


def test_chunks_give_the_tokenizer_s_own_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    known = packing.ChunkIds(queries.tokenizer_path())
    for text in ("Don't stop, it's 3.14!? OK... a,b ,c", "ÀÉÎ naïve É é İstanbul ΣΑΣ, ſ K.", "<|ENDOFTEXT|> <|endoftext|>x, y.", "tab\tnew\nline\x0b\x0c\x1c  x.", "'S 'll. a's, x'", "ab.!? cd!x e,."):
        assert known.of(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_words_go_to_the_model_alone_and_once():
    """Of a new word the tokenizer's normalizer, pre-tokenizer and bookkeeping cost seven times its model."""
    known = packing.ChunkIds(queries.tokenizer_path())
    whole, asked = known.tokenizer, []

    class Counting:
        def encode(self, chunk, **options):
            asked.append(chunk)
            return whole.encode(chunk, **options)

    known.tokenizer = Counting()
    text = "Anblewh sttible, éèauxai. ÉÈAUXAI%%% ñasíñ; straße*** Anblewh&&& sttible 12 don't"
    for _ in range(2):
        assert known.of(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert sorted(asked) == sorted([",", ".", "%%%", ";", "***", "&&&", "12", "don't"])


def test_words_of_all_letters_and_marks():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    known = packing.ChunkIds(queries.tokenizer_path())
    rng = np.random.default_rng(5)
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xAA, 0x180), 0x301, 0x345, 0x2028, 0x4E2D, 0x1F600)]
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    some = lambda of, n: "".join(rng.choice(of, rng.integers(0, n)))
    for _ in range(3000):
        text = some(marks, 2) + some(letters[:52] if rng.random() < 0.5 else letters, 9) + some(marks, 4) + some(["", " ", "\n", "s"], 3) + some(letters, 5)
        assert known.of(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_texts_are_cut_into_slices_anywhere(awkward):
    docs = awkward.select("doc_id", "text")
    want = sorted(map(tuple, packing.pieces(docs, queries.tokenizer_path(), 64).collect()), key=str)
    for most in (1, 60, 16_000):
        known = packing.ChunkIds(queries.tokenizer_path())
        texts = pa.array([r.text for r in docs.collect()])
        parts = packing.slices(texts, most)
        assert [a for a, _ in parts] == [0, *[b for _, b in parts]][: len(parts)] and parts[-1][1] == len(texts)
        found = [i for a, b in parts for i in known.of_texts(texts[a:b]).to_pylist()]
        assert found == known.of_texts(texts).to_pylist()
    assert len(want) == sum(-(-(len(i) // 4 + 1) // 64) for i in found)
