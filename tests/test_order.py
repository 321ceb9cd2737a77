import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright.operators import order


@pytest.mark.parametrize("accuracy", [20_000, 50])
def test_equals_the_exact_aggregate(spark, monkeypatch, accuracy):
    monkeypatch.setattr(order, "ACCURACY", accuracy)
    rng = random.Random(3)
    rows = [("uniform", rng.random()) for _ in range(4000)] + [("one value", 2.5)] * 900 + [("half", rng.choice([1.0, 1.0, rng.gauss(0, 1e6)])) for _ in range(3001)]
    rows += [("single", -7.0), ("two", 1.0), ("two", 2.0), ("none", None), ("wide", -1e308), ("wide", 1e308), ("wide", 0.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    names = {"lowest": 0.0, "quarter": 25.0, "median": 50.0, "high": 95.0, "highest": 100.0}
    got = {r.g: r for r in order.percentiles(df, F.col("v"), names, ("g",)).collect()}
    want = {r.g: r for r in df.where("v is not null").groupBy("g").agg(*(F.percentile("v", F.lit(q / 100)).alias(n) for n, q in names.items())).collect()}
    assert set(got) == set(want) == {"uniform", "one value", "half", "single", "two", "wide"}
    for g, r in want.items():
        assert [getattr(got[g], n) for n in names] == pytest.approx([getattr(r, n) for n in names], rel=1e-12), g
    every = order.percentiles(df.where("g = 'uniform'"), F.col("v"), {"p": 37.5}).collect()
    assert every[0].p == pytest.approx(np.percentile([v for g, v in rows if g == "uniform"], 37.5))


def test_nothing_has_no_percentile(spark):
    assert order.percentiles(spark.range(0), F.col("id"), {"p": 50.0}).count() == 0


def test_only_the_bracket_is_held(spark, monkeypatch):
    monkeypatch.setattr(order, "ACCURACY", 1000)
    found = order.percentiles(spark.range(100_000), F.col("id"), {"p": 95.0})
    assert found.first().p == pytest.approx(94_999.05)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan.replace("percentile_approx(", "")
