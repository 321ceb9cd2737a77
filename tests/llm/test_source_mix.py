import pytest

from spanwright.llm import source_mix as m


def taken(docs, **how):
    sized = m.sizes(docs)
    return m.mix(sized, m.rules(sized, m.targets(sized, **how))).collect()


def fill(sizes, weights, share, limit):
    """Targets by handing excess over again and again."""
    target, full, rest = dict.fromkeys(sizes, 0.0), set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in sizes if s not in full]
        level = (rest - sum(limit * sizes[s] for s in full)) / sum(weights[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weights[s] > limit * sizes[s]]
        if not over:
            return {s: limit * sizes[s] if s in full else level * weights[s] for s in sizes}
        full |= set(over)


def test_targets_match_repeated_sharing_and_mix_comes_near(spark, documents):
    docs = documents(*((k, "w " * (1 + k % 17), ("a", "b", "ü", None, "c")[k % 5 if k % 7 else 0]) for k in range(900)))
    rows = taken(docs)
    sizes, names = {}, sorted({r.source for r in rows if r.source}, key=lambda s: [ord(c) for c in s]) + [None]
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5, 2)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert own[0].target == pytest.approx(want[s]) and own[0].source_size == sizes[s]
        assert abs(sum(r["size"] * r.copies for r in own) - want[s]) <= 17
        assert max(r.copies for r in own) <= 2
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in taken(docs))


def test_mixes_are_nested(spark, documents):
    sized = m.sizes(documents(*((k, "w " * (1 + k % 5), "ab"[k % 2]) for k in range(400))))
    rules = m.rules(sized, m.targets(sized), (0.2, 0.5, 1.0))
    small, half, whole = ({r.doc_id: r.copies for r in m.mix(sized, rules, k).collect()} for k in range(3))
    assert all(small[d] <= half[d] <= whole[d] for d in small) and sum(small.values()) < sum(half.values())


def test_odd_rows(odd):
    rows = taken(odd)
    assert len(rows) == odd.count()
    assert m.repeat(odd).columns == odd.columns
    assert sum(r.copies for r in rows) == m.repeat(odd).count()
    assert m.repeat(odd.limit(0)).count() == 0
