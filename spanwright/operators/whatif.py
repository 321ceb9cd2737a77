"""What-if replay: change a parameter of a stage, and classify the changed trace again.

``attempts`` asks an adapter what a trace would look like under a mutation. ``Simulated`` has an effect for four of them, all of
which are worked out in one pass over the failed traces; a mutation that it has no model for leaves the trace as it is, with a note.
An adapter that really runs a pipeline again may also know the outcome.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import Limits, mean_of, of_stage, scores
from .classify import verdicts
from .health import measures

#: What a rewritten query adds to each score and where scores end, what a stronger reranker gains, the share of the context that a prompt may fill.
LIFT, CEILING, RERANK_LIFT, PROMPT_SHARE = 0.18, 0.97, 0.08, 0.6


@dataclass(frozen=True)
class Mutation:
    stage: str
    param: str
    value: int | str

    @property
    def name(self) -> str:
        return f"{self.stage}.{self.param}"


DEFAULTS = (Mutation("retrieve", "top_k", 10), Mutation("retrieve", "query_rewrite", "expanded"), Mutation("rerank", "reranker", "strong"), Mutation("generate", "context_limit", 16384))


def _more_hits(s: Column, k: int) -> Column:
    """Extra hits score below the mean, each a little lower; an empty result stays empty."""
    a = s["attrs"]
    extra = F.transform(F.sequence(F.lit(0), F.lit(k) - F.coalesce(a["top_k"], F.lit(0)) - 1), lambda i: F.round(F.greatest(F.lit(0.05), mean_of(scores(s)) - 0.05 - i * 0.02), 3))
    grows = (F.size(scores(s)) > 0) & (F.coalesce(a["top_k"], F.lit(0)) < k)
    merged = F.reverse(F.array_sort(F.concat(scores(s), extra)))
    a = a.withField("hit_scores", F.when(grows, merged).otherwise(a["hit_scores"])).withField("hit_count", F.when(grows, F.size(merged)).otherwise(a["hit_count"]))
    return s.withField("attrs", a.withField("top_k", F.lit(k)))


def _rewritten(s: Column) -> Column:
    a = s["attrs"]
    lifted = F.transform(scores(s), lambda x: F.round(F.least(F.lit(CEILING), x + LIFT), 3))
    some = F.size(scores(s)) > 0
    a = a.withField("hit_scores", F.when(some, lifted).otherwise(a["hit_scores"])).withField("hit_count", F.when(some, F.size(lifted)).otherwise(a["hit_count"]))
    return s.withField("attrs", a.withField("query", F.when(some, F.concat(F.coalesce(a["query"], F.lit("")), F.lit(" [rewritten]"))).otherwise(a["query"])))


def _reranked(s: Column) -> Column:
    a = s["attrs"]
    return s.withField("attrs", a.withField("rerank_delta", F.round(F.coalesce(a["rerank_delta"], F.lit(0.0)) + RERANK_LIFT, 4)))


def _shortened(s: Column, limit: int) -> Column:
    a = s["attrs"]
    a = a.withField("prompt_chars", F.least(F.coalesce(a["prompt_chars"], F.lit(0)), F.lit(int(limit * PROMPT_SHARE))))
    return s.withField("attrs", a.withField("finish_reason", F.when(a["finish_reason"] == "length", "stop").otherwise(a["finish_reason"])))


def _effect(m: Mutation):
    """From a span to the span under the mutation; None without a model."""
    return {
        ("retrieve", "top_k"): lambda s: _more_hits(s, int(m.value)), ("retrieve", "query_rewrite"): _rewritten,
        ("rerank", "reranker"): _reranked, ("generate", "context_limit"): lambda s: _shortened(s, int(m.value)),
    }.get((m.stage, m.param))


def _mutated(spans: Column, m: Mutation) -> Column:
    effect = _effect(m)
    return spans if effect is None else F.transform(spans, lambda s: F.when(s["stage"] == m.stage, effect(s)).otherwise(s))


def mutate(traces: DataFrame, m: Mutation) -> DataFrame:
    """``traces`` as they might have run under the mutation; unknown ones change nothing."""
    return traces.withColumn("spans", _mutated(F.col("spans"), m))


class Adapter(Protocol):
    """What runs traces again."""

    def rerun(self, traces: DataFrame, mutations: tuple[Mutation, ...]) -> DataFrame:
        """``traces``, once for each mutation: with its number in ``__m``, spans as they come out, note (or null) and actual, whether the failure was gone (null: unknown)."""
        ...


class Simulated:
    """The effects of this module; it never knows the actual outcome."""

    def rerun(self, traces: DataFrame, mutations: tuple[Mutation, ...]) -> DataFrame:
        rows = traces.withColumn("__m", F.explode(F.array(*map(F.lit, range(len(mutations))))))
        spans, note = F.col("spans"), F.lit(None).cast("string")
        for k, m in enumerate(mutations):
            if _effect(m) is None:
                note = F.when(F.col("__m") == k, f"no model of {m.name}: nothing was changed").otherwise(note)
            else:
                spans = F.when(F.col("__m") == k, _mutated(F.col("spans"), m)).otherwise(spans)
        return rows.select(*(c for c in rows.columns if c != "spans"), spans.alias("spans"), note.alias("note"), F.lit(None).cast("boolean").alias("actual"))


def attempts(traces: DataFrame, limit: DataFrame, mutations: tuple[Mutation, ...] = DEFAULTS, limits: Limits = Limits(), adapter: Adapter | None = None) -> DataFrame:
    """trace_id, mutation, before, after, score_lift, lift, total_lift, actual, note, resolved of the failed traces under each mutation.

    ``lift`` has the change of each of the ``measures`` of health, null where a trace has no such span; ``total_lift`` is their sum.
    Resolved: no failure, or another one, under the same cost ``limit``.
    """
    if not mutations:
        raise ValueError("at least one mutation is needed")
    failed = verdicts(traces, limits, limit).where("verdict is not null").withColumn("before", F.col("verdict.taxonomy_id")).drop("verdict")
    was = mean_of(scores(of_stage(F.col("spans"), "retrieve")))
    failed = failed.withColumn("__was", was).withColumn("__measures", F.struct(*(v.alias(n) for n, v in measures(F.col("spans")).items())))
    rows = verdicts((adapter or Simulated()).rerun(failed, mutations), limits, limit)
    change = {n: F.round(v - F.col("__measures")[n], 4) for n, v in measures(F.col("spans")).items()}
    name = F.array(*(F.lit(m.name) for m in mutations))[F.col("__m")]
    rows = rows.select("trace_id", "__m", name.alias("mutation"), "before", F.col("verdict.taxonomy_id").alias("after"), (was - F.col("__was")).alias("score_lift"), F.struct(*(v.alias(n) for n, v in change.items())).alias("lift"), "actual", "note")
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col("lift")[n], F.lit(0.0)) for n in change))
    return rows.select("trace_id", "mutation", "before", "after", "score_lift", "lift", F.round(total, 4).alias("total_lift"), "actual", "note", (~F.col("after").eqNullSafe(F.col("before"))).alias("resolved"), F.col("__m").alias("number"))


def best(attempts: DataFrame) -> DataFrame:
    """trace_id, mutation, total_lift: of the attempts that resolve, that with the largest total lift (ties to the one named first)."""
    first = F.struct(-F.col("total_lift"), F.col("number"))
    return attempts.where("resolved").groupBy("trace_id").agg(F.min_by("mutation", first).alias("mutation"), F.max("total_lift").alias("total_lift"))


__all__ = ["DEFAULTS", "Adapter", "Mutation", "Simulated", "attempts", "best", "mutate"]
