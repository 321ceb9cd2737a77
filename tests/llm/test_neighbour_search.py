import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright.llm import neighbour_search as m

VECTORS = "vec_id long, embedding array<float>, label int"


def search(spark, rows, every=10, **how):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    return m.search(df, F.col("id") % every == 0, **how).orderBy("query_id", "rank").collect()


def brute(rows, every=10, k=10):
    out = []
    for q, v in rows:
        if q is not None and q % every == 0:
            d = sorted((float(np.sqrt(((np.float64(w) - np.float64(v)) ** 2).sum())), i) for i, w in rows if i != q)
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(d[:k])]
    return sorted(out)


def test_one_partition_is_exact_with_ties_and_copies(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3) + 0.5]) for i in range(300)]
    got = search(spark, rows, parts=1)
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [x[:3] for x in brute(rows)]
    assert [r.score for r in got] == pytest.approx([x[3] for x in brute(rows)])


def test_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + 0.7 * rng.normal(size=16)]) for i in range(3000)]
    got, want = search(spark, rows), brute(rows)
    hits = {x[::2] for x in ((r.query_id, r["rank"], r.vec_id) for r in got)} & {(q, i) for q, _, i, _ in want}
    assert len(got) == len(want) and len(hits) >= 0.9 * len(want)


def test_partition_is_balanced_and_follows_the_graph():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(200, 4)) + 20 * c for c in np.eye(4)])
    graph = m.neighbour_graph(x, 8)
    part = m.balanced_partition(x, graph, 4)
    assert np.bincount(part).tolist() == [200] * 4
    assert (part[graph] == part[:, None]).mean() > 0.95


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (10, [0.0, 0.0]), (20, [nan, 1.0]), (30, [inf, 1.0]), (40, [None, 1.0]), (50, []), (60, [1.0]), (None, [1.0, 2.0])]
    good = [(70, [1.0, 0.0]), (80, [1.0, 0.0]), (80, [1.0, 0.0]), (81, [1.0, -0.0]), (82, [4.0, 4.0])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in search(spark, rows + good)]
    assert got == [(70, 1, 80, 0.0), (70, 2, 81, 0.0), (70, 3, 82, 5.0), (80, 1, 70, 0.0), (80, 2, 81, 0.0), (80, 3, 82, 5.0)]
    assert search(spark, rows) == []
    assert search(spark, []) == []


def test_a_very_common_vector(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(x) for x in rng.normal(size=3)]) for i in range(600)]
    got = search(spark, rows, parts=1)
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [x[:3] for x in brute(rows)]
