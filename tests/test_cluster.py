import random
from collections import defaultdict

import numpy as np
import pytest

from spanwright.operators import cluster


def vectors(spark, texts):
    points = spark.createDataFrame(sorted(texts.items()), "text string, n long")
    weights = cluster.tfidf(points, "text", "text", copies="n")
    rows = weights.collect()
    names, terms = sorted(texts), sorted({r.term for r in rows})
    x = np.zeros((len(names), len(terms)))
    for r in rows:
        x[names.index(r.text), terms.index(r.term)] = r.weight
    return points, weights, names, x


def linkage(x, n, cut):
    """One pair after the other, from all pairs of members."""
    groups = [[k] for k in range(len(x))]
    far = 1 - np.clip(x @ x.T, 0, 1)

    def mean(a, b):
        return sum(far[i, j] * n[i] * n[j] for i in a for j in b) / (sum(n[i] for i in a) * sum(n[j] for j in b))

    while len(groups) > 1:
        d, a, b = min((round(mean(a, b), 11), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if d > cut:
            break
        groups[a] += groups.pop(b)
        groups.sort(key=min)
    return {frozenset(g) for g in groups}


def drawn(seed, count):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta") for b in ("one", "two", "three")]
    texts = {}
    for _ in range(count):
        family = rng.randrange(4)
        own = [words[3 * family + rng.randrange(3)] for _ in range(rng.randint(2, 5))]
        texts["shared " + " ".join(own + rng.choices(words, k=rng.randint(0, 2)))] = rng.randint(1, 4)
    return texts


@pytest.mark.parametrize("seed, count, cut", [(1, 25, 0.62), (2, 40, 0.4), (3, 18, 0.8), (4, 12, 0.05)])
def test_linkage_equals_one_pair_after_the_other(spark, seed, count, cut):
    texts = drawn(seed, count)
    points, weights, names, x = vectors(spark, texts)
    found = defaultdict(set)
    for r in cluster.average_linkage(points, weights, cut).collect():
        found[r.c].add(names.index(r.text))
    assert {frozenset(v) for v in found.values()} == linkage(x, [texts[t] for t in names], cut)
    assert all(names[min(v)] == c for c, v in found.items())


def test_kmeans_ends_with_every_text_nearest_to_its_own_centre(spark):
    texts = drawn(5, 50)
    points, weights, names, x = vectors(spark, texts)
    got = {r.text: r.cluster for r in cluster.kmeans(points, weights, 4).collect()}
    again = {r.text: r.cluster for r in cluster.kmeans(points.repartition(5), weights.repartition(3), 4).collect()}
    assert got == again and set(got) == set(names) and set(got.values()) == set(range(4))
    own, n = np.array([got[t] for t in names]), np.array([texts[t] for t in names])
    centres = np.stack([np.average(x[own == k], axis=0, weights=n[own == k]) for k in range(4)])
    far = np.round(((x[:, None] - centres[None]) ** 2).sum(2), 9)
    assert (far[np.arange(len(x)), own] == far.min(1)).all()


def test_kmeans_with_fewer_texts_than_parts(spark):
    points, weights, names, _ = vectors(spark, {"one thing": 2, "other matter": 1})
    assert len({r.cluster for r in cluster.kmeans(points, weights, 5).collect()}) == 2


def test_terms_stay_with_their_texts(spark, monkeypatch):
    texts = spark.createDataFrame([(k % 7, f"red blue_{k % 3} word{k} red") for k in range(20)] + [(None, "red"), (8, None)], "i long, t string")
    found = cluster.tfidf(texts, "i", "t")
    rows = lambda df: sorted((r.i if r.i is not None else -1, r.term, round(r.weight, 9)) for r in df.collect())
    got = rows(found)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1  # texts by id; a row for each term is never shuffled
    monkeypatch.setattr(cluster, "HELD", 0)
    assert rows(cluster.tfidf(texts, "i", "t")) == got and (-1, "red", 1.0) in got
    assert sum(w * w for i, _, w in got if i == 3) == pytest.approx(1)
