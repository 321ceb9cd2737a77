"""Traces written by hand, with the outcome written by hand."""

import json
import re

import pytest
from pyspark.sql import functions as F

from spanwright.functions.rules import Limits
from spanwright.operators import blame, chain, classify, health
from spanwright.schema import TRACES


def span(stage, span_id=None, duration=10.0, status="ok", cost=0.0, **attrs):
    return {"span_id": span_id or stage, "name": stage, "stage": stage, "duration_ms": duration, "status": status, "tokens_in": 1, "tokens_out": 1, "cost": cost, "attrs": attrs}


def good(**generate):
    return [
        span("embed", token_count=8.0), span("retrieve", top_k=4, hit_count=2, hit_scores=[0.8, 0.9]), span("rerank", rerank_delta=0.2),
        span("generate", cost=0.01, **({"prompt_chars": 100, "finish_reason": "stop", "output": "The river rises in spring.", "context": "The river rises in spring after snow."} | generate)),
    ]


@pytest.fixture
def cohort(spark):
    def make(**traces):
        rows = []
        for name, spans in traces.items():
            spans = [s | {"pos": k} for k, s in enumerate(spans)]
            rows.append((json.dumps({"trace_id": name, "ts": "2026-01-01T00:00:00Z", "day": "2026-01-01", "pipeline_name": "p", "total_cost": sum(s["cost"] for s in spans), "spans": spans}),))
        return spark.createDataFrame(rows, "j string").select(F.from_json("j", TRACES).alias("t")).select("t.*")

    return make


def test_each_rule_fires_on_its_trace(cohort):
    loop = "the same words come back again " * 14
    cases = {
        "healthy": (good(), None),
        "cut": (good(finish_reason="length", prompt_chars=8190), "F-PROMPT-001"),
        "cut_short": (good(finish_reason="length", prompt_chars=200), None),
        "json": (good(output='{"a": [1, 2', output_format="json"), "F-GEN-001"),
        "json_by_look": (good(output=' {"a": 1,}'), "F-GEN-001"),
        "json_fine": (good(output='{"a": 1}', output_format="json"), None),
        "loop": (good(output=loop), "F-GEN-002"),
        "loop_short": (good(output="go go go go go go go go"), None),  # below 80 characters
        "refusal": (good(output="I cannot answer that question."), "F-GEN-003"),
        "refusal_without_context": ([*good(output="I cannot answer that question.")[:1], span("generate", output="I cannot answer that question.")], None),
        "empty": ([span("retrieve", hit_count=0, hit_scores=[])], "F-RET-001"),
        "weak": ([span("retrieve", hit_count=1, hit_scores=[0.2])], "F-RET-002"),
        "slow": ([*good()[:3], span("generate", status="timeout", duration=30_000.0)], "F-INFRA-001"),
        "tool": ([span("tool", status="error", error="no such file")], "F-TOOL-001"),
    }
    found = {r.trace_id: r.taxonomy_id for r in classify.failures(cohort(**{k: v[0] for k, v in cases.items()})).collect()}
    assert found == {k: v[1] for k, v in cases.items() if v[1]}


def test_cost_far_above_the_cohort(cohort):
    traces = {f"t{k:02}": [span("generate", cost=0.01 + k / 10_000)] for k in range(30)} | {"dear": [span("generate", cost=1.0)]}
    assert [r.trace_id for r in classify.failures(cohort(**traces), Limits()).collect()] == ["dear"]
    few = dict(list(traces.items())[-10:])
    assert classify.failures(cohort(**few)).count() == 0  # too few costs for a limit


def test_blast_radius_begins_at_the_evidence(cohort):
    spans = [span("retrieve", "r1"), span("generate", "g1", cost=1.0), span("retrieve", "r2", cost=2.0), span("guard", "x", cost=4.0), span("tool", "y", cost=8.0)]
    traces = cohort(a=spans, b=spans, c=spans[:1], d=spans[:1])
    failures = traces.sparkSession.createDataFrame([("a", "retrieve", [("r2",)]), ("b", "retrieve", [("gone",)]), ("c", "generate", []), ("d", "tool", [])], "trace_id string, stage string, evidence array<struct<span_id:string>>")
    got = {r.trace_id: (r.downstream, r.stages, r.cost, r.user_facing) for r in chain.blast_radius(traces, failures).collect()}
    assert got == {"a": (2, "guard,tool", 12.0, False), "b": (4, "generate,guard,retrieve,tool", 15.0, True), "c": (0, "", 0.0, True), "d": (0, "", 0.0, False)}


def test_the_last_failure_of_a_trace_counts(spark):
    rows = spark.createDataFrame([("a", "X", "tool", 1), ("a", "A", "guard", 2), ("b", "Y", "embed", 1)], "trace_id string, taxonomy_id string, stage string, seq int")
    assert {tuple(r) for r in blame.last_failure(rows).collect()} == {("a", "A", "guard"), ("b", "Y", "embed")}
    assert {tuple(r) for r in blame.last_failure(rows.drop("seq")).collect()} == {("a", "X", "tool"), ("b", "Y", "embed")}


def test_cards_take_the_worst_status(cohort):
    weak = [span("retrieve", top_k=4, hit_count=1, hit_scores=[0.3]), span("rerank", rerank_delta=0.0), span("generate", output="Planets are made of cheese 77.", context="The river rises in spring.")]
    cards = {r.stage: r for r in health.report_cards(cohort(a=weak, b=[span("retrieve", top_k=4, hit_count=0)], c=[span("agent")])).collect()}
    assert list(cards) == ["retrieve", "rerank", "generate"]
    assert (cards["retrieve"].status, cards["retrieve"].metrics["hit_rate"], cards["retrieve"].metrics["k_coverage"], len(cards["retrieve"].flags)) == ("crit", 0.5, 0.125, 2)
    assert (cards["rerank"].status, cards["generate"].status) == ("warn", "crit")
    fine = {r.stage: (r.status, r.flags) for r in health.report_cards(cohort(a=good())).collect()}
    assert fine == dict.fromkeys(["embed", "retrieve", "rerank", "generate"], ("ok", []))
    assert health.report_cards(cohort(a=good()).limit(0)).count() == 0


def test_measures_of_a_trace(cohort):
    rows = {r.trace_id: (r.mean_hit_score, r.groundedness, r.rerank_delta) for r in health.trace_health(cohort(a=good(), b=[span("retrieve"), span("rerank")], c=[span("tool")])).collect()}
    assert rows == {"a": (0.85, 1.0, 0.2), "b": (0.0, None, 0.0), "c": (None, None, None)}


def test_blame_shuffles_no_texts(spark):
    """Only what was measured is shuffled, not the spans with their outputs."""
    traces = spark.createDataFrame([{"trace_id": "a", "spans": good()}, {"trace_id": "b", "spans": good()}], TRACES)
    failures = spark.createDataFrame([("b", "F-GEN-003", "generate")], "trace_id string, taxonomy_id string, stage string")
    base = blame.baseline(traces, failures)
    for found in (base, blame.candidates(traces, failures, base)):
        plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
        moved = [block for block in plan.split("\n\n") if re.search(r"^\(\d+\) Exchange", block, re.M)]
        assert moved and not any("spans#" in block or "attrs" in block for block in moved)
