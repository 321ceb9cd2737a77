import pytest
from pyspark.sql import functions as F

from spanwright.operators import classify, whatif
from spanwright.operators.whatif import Mutation
from spanwright.sources import planted


@pytest.fixture(scope="module")
def found(spark):
    traces = planted.corpus(spark, days=14, per_day=20).drop("planted", "day_no").persist()
    limit = classify.cost_limit(traces).persist()

    def run(*mutations, adapter=None):
        return {(r.trace_id, r.mutation): r for r in whatif.attempts(traces, limit, mutations or whatif.DEFAULTS, adapter=adapter).collect()}

    run.traces, run.limit = traces, limit
    return run


@pytest.fixture(scope="module")
def stock(found):
    return found()


def of(rows, taxonomy_id, mutation):
    return [r for (_, m), r in rows.items() if m == mutation and r.before == taxonomy_id]


def test_a_better_query_resolves_weak_retrievals(stock):
    rows = of(stock, "F-RET-002", "retrieve.query_rewrite")
    assert rows and all(r.resolved and r.after is None and r.lift.mean_hit_score == pytest.approx(0.18, abs=1e-3) for r in rows)


def test_more_hits_dilute_and_resolve_nothing(stock):
    rows = of(stock, "F-RET-002", "retrieve.top_k")
    assert rows and not any(r.resolved for r in rows) and all(r.lift.mean_hit_score < 0 for r in rows)


def test_an_empty_index_stays_empty(found, stock):
    assert not any(r.resolved for m in ("retrieve.top_k", "retrieve.query_rewrite") for r in of(stock, "F-RET-001", m))
    changed = whatif.mutate(found.traces.where("exists(spans, s -> s.attrs.hit_count = 0)"), Mutation("retrieve", "top_k", 10))
    spans = [s for r in changed.collect() for s in r.spans if s.stage == "retrieve"]
    assert spans and all(s.attrs.hit_scores == [] and s.attrs.hit_count == 0 and s.attrs.top_k == 10 for s in spans)


def test_more_hits_by_hand(spark, found):
    one = found.traces.limit(1).withColumn("spans", F.transform(F.filter("spans", lambda s: s["stage"] == "retrieve"), lambda s: s.withField("attrs", s["attrs"].withField("hit_scores", F.array(F.lit(0.9), F.lit(0.1))).withField("top_k", F.lit(2)))))
    got = whatif.mutate(one, Mutation("retrieve", "top_k", 5)).first().spans[0].attrs
    assert got.hit_scores == [0.9, 0.45, 0.43, 0.41, 0.1] and got.hit_count == 5 and got.top_k == 5
    low = whatif.mutate(one, Mutation("retrieve", "top_k", 1)).first().spans[0].attrs
    assert low.hit_scores == [0.9, 0.1] and low.top_k == 1


def test_a_larger_context_resolves_truncation(stock):
    rows = of(stock, "F-PROMPT-001", "generate.context_limit")
    assert rows and all(r.resolved for r in rows)


def test_a_stronger_reranker_gains_but_resolves_nothing(stock):
    rows = of(stock, "F-RET-002", "rerank.reranker")
    assert not any(r.resolved for r in rows)
    assert {r.lift.rerank_delta for r in rows} <= {0.08, None} and any(r.lift.rerank_delta for r in rows)


def test_what_has_no_model_is_noted(found):
    rows = found(Mutation("generate", "model", "large"), Mutation("retrieve", "top_k", 10))
    plain = [r for (_, m), r in rows.items() if m == "generate.model"]
    assert plain and all(r.note == "no model of generate.model: nothing was changed" and not r.resolved and r.total_lift == 0 and r.actual is None for r in plain)
    assert all(r.note is None for (_, m), r in rows.items() if m == "retrieve.top_k")
    with pytest.raises(ValueError):
        whatif.attempts(found.traces, found.limit, ())


def test_the_best_attempt(found):
    rows = whatif.attempts(found.traces, found.limit)
    got = {r.trace_id: r.mutation for r in whatif.best(rows).collect()}
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (-r.total_lift, r.number)):
        if r.resolved:
            want.setdefault(r.trace_id, r.mutation)
    assert got == want and set(want.values()) >= {"retrieve.query_rewrite", "generate.context_limit"}


def test_an_adapter_that_knows_the_outcome(found):
    class Real:
        def rerun(self, traces, mutations):
            better = F.transform("spans", lambda s: F.when(s["stage"] == "retrieve", s.withField("attrs", s["attrs"].withField("hit_scores", F.array(F.lit(0.9))).withField("hit_count", F.lit(1)))).otherwise(s))
            return traces.select("*", F.lit(0).alias("__m"), F.lit("ran").alias("note"), F.lit(True).alias("actual")).withColumn("spans", better)

    rows = of(found(Mutation("retrieve", "index", "new"), adapter=Real()), "F-RET-002", "retrieve.index")
    assert rows and all(r.actual and r.resolved and r.note == "ran" for r in rows)
