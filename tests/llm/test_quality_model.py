import numpy as np

from spanwright.llm import quality_model as m


def corpus(n=240):
    rng = np.random.default_rng(0)
    good = [(i, " ".join(f"{'abcdefghij'[a]}o{'klmnop'[b]}e" for a, b in rng.integers(0, 6, (80, 2))) + ".") for i in range(n)]
    bad = [(n + i, " ".join(f"X{a}$$$ ### A{b}" for a, b in rng.integers(0, 6, (80, 2)))) for i in range(n // 3)]
    return good, bad


def test_unlabelled_negatives_score_low(spark, documents):
    good, bad = corpus()
    docs = documents(*good, *bad)
    model = m.learn(docs, spark.createDataFrame([(i,) for i, _ in good[:120]], "doc_id long"))
    got = {r.doc_id: r.score for r in m.score(docs, model).collect()}
    assert 0.55 < model.prior < 0.95
    assert np.mean([got[i] > 0.5 for i, _ in good[120:]]) > 0.95 and np.mean([got[i] < 0.3 for i, _ in bad]) > 0.95


def test_prior_from_scores():
    rng = np.random.default_rng(1)
    positive = rng.normal(3, 1, 4000)
    mixed = np.concatenate([rng.normal(3, 1, 2800), rng.normal(-3, 1, 1200)])
    assert abs(m.class_prior(positive, mixed) - 0.7) < 0.06


def test_a_text_longer_than_a_part_counts_whole():
    text = ("aé bc\n" * 900_000) + "Z!"
    whole = m.features(text)
    assert whole[ord("A")] > 0 and whole[ord("!")] > 0 and np.isfinite(whole).all()


def test_odd_rows(spark, odd):
    model = m.learn(odd, spark.createDataFrame([(4,), (5,), (5,), (None,)], "doc_id long"))
    rows = m.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    none = m.learn(odd, spark.createDataFrame([], "doc_id long"))
    assert {r.score for r in m.score(odd, none).collect()} == {0.5}
    assert m.score(odd.limit(0), m.learn(odd.limit(0), spark.createDataFrame([(1,)], "doc_id long"))).count() == 0
