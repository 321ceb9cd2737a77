"""Incident pages, reports and the second pass, over traces written by hand."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_planted import cohort, good, span  # noqa: F401  cohort is a fixture

from spanwright.operators import ambiguous, blame, classify, cluster, incident, report


def story():
    """A weak retrieval, an answer from it, and a guard that lets it pass."""
    return [
        span("retrieve", "r", query="why is\nthe sky blue?", top_k=4, hit_count=2, hit_scores=[0.2, 0.3]),
        span("generate", "g", cost=0.5, output='it "just" is', context="clouds", finish_reason="stop"), span("guard", "x", cost=0.25),
    ]


def test_the_chain_of_a_case(cohort):  # noqa: F811
    traces = cohort(a=story(), b=good(), c=[span("tool", status="error", error="no such file")])
    rows = {r.trace_id: r for r in incident.cases(traces, classify.failures(traces)).collect()}
    assert set(rows) == {"a", "c"}
    a, c = rows["a"], rows["c"]
    assert tuple(a.trigger) == ("r", "retrieve", "why is\nthe sky blue?") and tuple(c.trigger) == ("tool", "tool", "")
    assert (a.poisoning.span_id, a.poisoning.hits, a.poisoning.top_k, a.poisoning.weakest, a.poisoning.context) == ("r", 2, 4, 0.2, "clouds")
    assert a.poisoning.mean == pytest.approx(0.25) and c.poisoning.weakest is None
    assert tuple(a.divergence) == ("g", 'it "just" is', "stop") and tuple(c.divergence) == (None, None, None)
    assert (a.guard.state, a.guard.names, c.guard.state) == ("passed", ["guard"], "absent") and "scores" in a.guard.expected
    assert [(s.stage, s.fault) for s in a.path] == [("retrieve", True), ("generate", False), ("guard", False)]
    assert (a.blast.downstream, a.blast.stages, a.blast.cost, a.blast.user_facing) == (2, ["generate", "guard"], 0.75, True)
    assert (c.blast.downstream, c.blast.stages, c.blast.user_facing) == (0, [], False)


def test_pages_and_tickets(cohort):  # noqa: F811
    blocked = [*story()[:2], span("guard", "x", blocked=True)]
    traces = cohort(a=story(), b=good(), c=[span("tool", status="error", error="no such | file")], d=blocked)
    failures = classify.failures(traces)
    rows = {r.trace_id: r for r in incident.pages(traces, failures, titles={"F-RET-002": "Thin context"}, playbooks={"F-TOOL-001": "Restart it"}).collect()}
    page, ticket = rows["a"].page.split("\n"), rows["a"].ticket.split("\n")
    assert page[:3] == ["# Thin context (F-RET-002)", "", "Trace `a` of p, 2026-01-01T00:00:00Z; stage at fault: retrieve (rule, 0.85)."]
    assert page[6:12] == [
        "- asked: why is the sky blue?", "- found: 2 hits of 4, scores from 0.200, 0.250 on average", "- read: clouds", '- answered: it "just" is (stop)', "- checked: by guard, without an objection",
        "- reached: 2 later spans (generate, guard) worth 0.7500; the user saw it",
    ]
    assert [x for x in page if x.startswith("    s")] == ['    s0["retrieve retrieve"]:::fault', '    s1["generate generate"]', '    s2["guard guard"]', "    s0 --> s1", "    s1 --> s2"]
    assert sum(x.startswith("| F-") for x in page) == 1 and sum(x.startswith("- [ ]") for x in page) == 3
    assert ticket[0] == "F-RET-002 Thin context" and ticket[-1].startswith("- to do: ") and any(x.startswith("- seen: ") for x in ticket)
    assert rows["c"].ticket.endswith("- to do: Restart it") and "- asked: not recorded" in rows["c"].page and "- found: nothing was searched" in rows["c"].page and "- reached: no later span; the user did not see it" in rows["c"].page
    assert "no such / file" in rows["c"].page and "by guard, which blocked it" in rows["d"].page
    assert incident.pages(traces.where("false"), failures).count() == 0


def test_short_tickets_and_reviews(cohort):  # noqa: F811
    traces = cohort(a=story(), b=good(), c=[span("tool", "k", status="error", error="no such file")])
    failures = classify.failures(traces)
    short = {r.trace_id: r.ticket.split("\n") for r in incident.tickets(failures, playbooks={"F-TOOL-001": "Restart it"}).collect()}
    assert set(short) == {"a", "c"} and short["c"][0].startswith("F-TOOL-001 ") and short["c"][0].endswith(" in c") and short["c"][-1] == "- to do: Restart it"
    assert any("no such file" in x for x in short["c"])
    top = failures.select("trace_id", "taxonomy_id", F.when(F.col("trace_id") == "a", "generate").otherwise(F.col("stage")).alias("stage"))
    forms = {r.trace_id: r.review for r in incident.reviews(traces, failures, top).collect()}
    assert "Furthest from normal: generate, the rules say retrieve (rule, 0.85)." in forms["a"] and "Furthest from normal: tool, as the rules say (rule, 0.90)." in forms["c"]
    assert incident.reviews(traces, failures, top.where("false")).count() == 2


def test_a_report_is_sorted_and_repeats(cohort):  # noqa: F811
    traces = cohort(a=[span("tool", status="error", error="x")], b=story(), c=story(), d=good(), e=[span("tool", status="error", error="y")])
    failures = classify.failures(traces)
    top = blame.top_stage(traces, failures, blame.baseline(traces, failures))
    text = report.report(traces, failures, top)
    assert text == report.report(traces, failures, top)
    assert "- 4 of 5 traces failed (80.0%)." in text
    assert "Most frequent: **F-TOOL-001" in text  # as frequent as F-RET-002; trace a comes first
    assert text.index("| F-RET-002 |") < text.index("| F-TOOL-001 |") and "Seen in `b`" in text and "Seen in `a`" in text
    assert "section Days 1 to 1\n        2026-01-01 : F-RET-002 x2 : F-TOOL-001 x2" in text
    empty = report.report(traces.where("false"), failures.where("false"))
    assert "- 0 of 0 traces failed (0.0%)." in empty and "No failures" in empty


def test_replies_are_read(spark):
    cases = {
        "TAXONOMY: F-GEN-002\nCONFIDENCE: 0.8": ("F-GEN-002", 0.8), "F-RET-001 or F-RET-002": ("F-RET-001", None), "TAXONOMY: F-GEN-002\nCONFIDENCE: 7": ("F-GEN-002", None),
        "TAXONOMY: UNKNOWN\nCONFIDENCE: 0.1": None, "F-GEN-001 CONFIDENCE: 0.1.2": None, "": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "reply string").select("reply", ambiguous.read_reply(F.col("reply")).alias("v")).collect()
    assert {r.reply: r.v and tuple(r.v) for r in rows} == cases
    assert spark.range(1).select(ambiguous.read_reply(F.lit(None).cast("string")).alias("v")).head().v is None


def test_second_pass(cohort):  # noqa: F811
    traces = cohort(
        fine=good(), ruled=[span("tool", status="error", error="x")], blank=[span("generate", "g", output=" ")],
        guarded=[*good()[:1], span("guard", "x", blocked=True)], broken=[span("graph", "k", status="error")],
    )
    verdicts = classify.verdicts(traces)
    plain = {r.trace_id: (r.taxonomy_id, r.stage, r.confidence, r.source) for r in ambiguous.second_pass(verdicts).collect()}
    assert plain == {"blank": ("F-GEN-001", "generate", 0.45, "fallback"), "guarded": ("F-INFRA-003", "guard", 0.45, "fallback"), "broken": ("F-INFRA-003", "graph", 0.45, "fallback")}

    def factory():
        def model(prompt):
            if "guard_blocked" in prompt:
                return "TAXONOMY: F-GEN-003\nCONFIDENCE: 0.9"
            if "span_error" in prompt:
                raise OSError("unreachable")
            return "no idea"

        return model

    asked = {r.trace_id: r for r in ambiguous.second_pass(verdicts, factory).collect()}
    assert {k: (r.taxonomy_id, r.stage, r.confidence, r.source) for k, r in asked.items()} == plain | {"guarded": ("F-GEN-003", "generate", 0.9, "llm")}
    assert [(e.span_id, e.key, e.value) for e in asked["guarded"].evidence] == [("embed", "status", "ok"), ("x", "status", "ok"), ("x", "blocked", "true")]
    scored = {r.trace_id: r.taxonomy_id for r in ambiguous.second_pass(verdicts, offline=True).collect()}
    assert scored["guarded"] == "F-INFRA-003" and set(scored) == set(plain)


def test_a_rule_of_ones_own(cohort):  # noqa: F811
    from spanwright.functions import rules

    def many_spans(spans, limits):
        return rules.verdict(F.size(spans) > 3, "F-OWN-001", "agent", 0.7, rules.evidence(F.get(spans, F.lit(0)), "spans", F.size(spans)))

    traces = cohort(a=good(), b=story())
    found = {r.trace_id: (r.taxonomy_id, r.evidence[0].value) for r in classify.failures(traces, rules=(*rules.RULES, many_spans)).collect()}
    assert found["a"] == ("F-OWN-001", "4") and found["b"][0] == "F-RET-002"
    assert classify.failures(traces).where("trace_id = 'a'").count() == 0


@pytest.mark.parametrize("linked", [True, False])  # with fewer clusters than linkage leaves, k-means parts them
def test_cards_of_families(cohort, linked):  # noqa: F811
    tools = {f"t{k:02}": [span("tool", status="error", error=e)] for k, e in enumerate(["no such file"] * 14 + ["no such folder"] * 3)}
    weak = {f"w{k}": [span("retrieve", hit_count=1, hit_scores=[0.2])] for k in range(4)}
    failures = classify.failures(cohort(**tools, **weak, one=[span("generate", status="timeout", duration=30_000.0)])).cache()
    members = cluster.families(failures, max_clusters=10 if linked else 2)
    of = {r.trace_id: r.cluster for r in members.collect()}
    if linked:
        assert len({of[t] for t in tools}) == len({of[w] for w in weak}) == 1 and len(set(of.values())) == 3
    assert len(of) == 22
    texts = {r.trace_id: Counter(re.findall("[a-z_][a-z0-9_]{2,}", r.text.lower())) for r in cluster.evidence_text(failures).collect()}
    df = Counter(t for c in texts.values() for t in c)
    kind, groups, total = {r.trace_id: r.taxonomy_id for r in failures.collect()}, defaultdict(list), defaultdict(Counter)
    for t, k in sorted(of.items()):
        groups[k].append(t)
        w = {x: n * (math.log(23 / (1 + df[x])) + 1) for x, n in texts[t].items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for x, v in w.items():
            total[k][x] += v / norm
    want = []
    for k in sorted((k for k in groups if len(groups[k]) > 1), key=lambda k: (-len(groups[k]), k)):
        ids, classes = groups[k], Counter(kind[t] for t in groups[k])
        top = min(classes, key=lambda c: (-classes[c], c))
        terms = sorted(total[k], key=lambda x: (-round(total[k][x], 9), x))[:5]
        want.append((len(want), len(ids), round(len(ids) / 22, 4), top, round(classes[top] / len(ids), 4), terms, ids[0], ids[:12]))
    assert [tuple(r) for r in cluster.family_cards(failures, members).collect()] == want
    assert cluster.family_cards(failures.where("false"), cluster.families(failures.where("false"))).count() == 0
