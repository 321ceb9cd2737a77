import itertools

import numpy as np
import pytest

from spanwright.llm import toxic_spans as m


def test_marginals_match_all_paths():
    rng = np.random.default_rng(0)
    turn = np.array([[0, -1.2], [0.4, 1.5]])
    chain = m.Chain(np.zeros(4), -0.7, turn, np.zeros(5))
    for e in (rng.normal(0, 2, 7), rng.normal(0, 2, 1)):
        total = np.zeros((2, len(e)))
        for path in itertools.product((0, 1), repeat=len(e)):
            w = np.exp(path[0] * -0.7 + sum(e[k] for k, s in enumerate(path) if s) + sum(turn[a, b] for a, b in itertools.pairwise(path)))
            for k, s in enumerate(path):
                total[s, k] += w
        assert chain.marginals([np.zeros(0), e, e[:1]])[1] == pytest.approx(np.log(total[1] / total[0]))


def corpus(n=400):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(["an", "ti", "er", "onu", "sh"], 3))
    rows = []
    for i in range(n):
        words = [word() for _ in range(60)]
        if i % 3 == 0:
            for at in rng.integers(0, 60, 3):
                words[at] = "scumbag" + rng.choice(["", "s", "gery"])
        rows.append((i, " ".join(words)))
    return rows


def test_held_out_documents_and_offsets(spark, documents):
    rows = corpus()
    docs = documents(*rows)
    chain = m.learn(docs, spark.createDataFrame([(i, i % 3 == 0) for i, _ in rows if i < 300], "doc_id long, toxic boolean"))
    got = {r.doc_id: r for r in m.tag(docs, chain).collect()}
    late = [(i, t) for i, t in rows if i >= 300]
    assert np.mean([(got[i].score >= 0.7) == (i % 3 == 0) for i, _ in late]) > 0.97
    spans = [t[s.start : s.end] for i, t in late for s in got[i].spans]
    assert spans and np.mean([all(w.startswith("scumbag") for w in s.split()) for s in spans]) > 0.9
    shifted = m.tag(documents((1, "ü🙂 " + rows[303 - 303 % 3][1])), chain).head()
    assert all(("ü🙂 " + rows[303 - 303 % 3][1])[s.start : s.end].startswith("scumbag") for s in shifted.spans)


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, True), (5, False), (5, None), (None, True), (2, False)], "doc_id long, toxic boolean")
    rows = m.tag(odd, m.learn(odd, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 2}) == 1
    nothing = m.learn(odd.limit(0), labels.limit(0))
    assert m.tag(odd.limit(0), nothing).count() == 0
