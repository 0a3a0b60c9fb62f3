from collections import defaultdict

from pelagos.llm import mixing


def filled(sizes, share, ceiling):
    left = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(left)}
    total, done = share * sum(sizes.values()), {}
    while left:
        level = (total - sum(done.values())) / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level > ceiling * sizes[s]]
        if not over:
            return done | {s: weight[s] * level for s in left}
        done |= {s: ceiling * sizes[s] for s in over}
        left = [s for s in left if s not in over]
    return done


def test_targets_and_taken(documents):
    rows = mixing.mix(documents).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    want = filled({s: sum(r.size for r in x) for s, x in by.items()}, 1.5, 2.0)
    for s, x in by.items():
        assert abs(x[0].target - want[s]) < 1e-6 * max(1, want[s])
    assert all(r.copies <= 2 for r in rows)
    taken, target = sum(r.size * r.copies for r in rows), sum(want.values())
    assert abs(taken - target) < 0.15 * target
    assert rows == mixing.mix(documents.repartition(7)).collect() or sorted(rows) == sorted(mixing.mix(documents.repartition(7)).collect())


def test_awkward_rows(awkward, nothing):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert mixing.mix(nothing).count() == 0
    out = mixing.mixed_documents(awkward)
    assert out.columns == awkward.columns
    assert out.count() == sum(r.copies for r in rows)
