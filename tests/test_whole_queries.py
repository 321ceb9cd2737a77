import math
import re
from collections import Counter

import numpy as np
import pytest

from spanwright.plans import catalog
from spanwright.plans.lenses import table

DATA = "/root/testdata/sf0.001"


def rows(spark, name):
    return catalog.QUERIES[name](spark, DATA).collect()


def test_each_failed_trace_has_four_attempts(spark):
    got = rows(spark, "whatif_all_attempts")
    some = {tuple(r) for r in rows(spark, "whatif_attempts")}
    assert len(got) == 2 * len(some) and some <= {tuple(r) for r in got}
    rest = [r for r in got if tuple(r) not in some]  # traces of events have no reranker's score and no cut prompt
    assert Counter(r.mutation for r in rest) == dict.fromkeys(["rerank.reranker", "generate.context_limit"], len(some) // 2)
    assert all(r.before == r.after and not r.resolved for r in rest)


def test_every_window_has_its_p(spark):
    got = rows(spark, "chi_square_p_all")
    assert len(got) == len(rows(spark, "chi_square_windows"))
    for r in got:
        p, a, x = (math.erfc(math.sqrt(r.chi2 / 2)), 0.5, r.chi2 / 2) if r.df % 2 else (math.exp(-r.chi2 / 2), 1, r.chi2 / 2)
        while 2 * a < r.df:
            p += x**a * math.exp(-x) / math.gamma(a + 1)
            a += 1
        assert r.p == pytest.approx(p, abs=2e-6) if r.df else r.p is None


def test_terms_of_all_documents(spark):
    docs = {r.doc_id: Counter(re.findall("[a-z_][a-z0-9_]{2,}", (r.text or "").lower())) for r in table(spark, DATA, "documents").collect()}
    df = Counter(t for c in docs.values() for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}
    got = {r.term: r for r in rows(spark, "doc_freq_idf_all")}
    assert min(df.values()) < 5 and {t: r.df for t, r in got.items()} == df
    assert all(r.idf == pytest.approx(idf[t], abs=2e-6) for t, r in got.items())
    norm = {k: math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items())) for k, c in docs.items()}
    weights = rows(spark, "tfidf_weights_documents")
    assert len(weights) == sum(map(len, docs.values()))
    assert all(r.weight == pytest.approx(docs[r.doc_id][r.term] * idf[r.term] / norm[r.doc_id], abs=2e-6) for r in weights)


def test_distances_within_and_between_labels(spark):
    own = table(spark, DATA, "embeddings").collect()
    x, label = np.array([r.embedding for r in own], float), np.array([r.label for r in own])
    i, j = np.triu_indices(len(x), 1)
    d, same = 1 - (x[i] * x[j]).sum(1), label[i] == label[j]
    (r,) = rows(spark, "label_pair_distances")
    assert r.intra == pytest.approx(d[same].mean()) and r.inter == pytest.approx(d[~same].mean())
