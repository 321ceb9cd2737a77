"""The failure rules as columns over a row of ``traces``: each gives a verdict struct or null."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import REFUSALS, clip, refusal, repeated_trigrams


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules."""

    low_score: float = 0.5
    context_chars: int = 8192
    context_share: float = 0.9
    repeats: int = 5
    cost_factor: float = 3.0
    refusals: tuple[str, ...] = REFUSALS


Rule = Callable[[Column, Limits], Column]


def first_span(spans: Column, test: Callable[[Column], Column]) -> Column:
    """The first span, in order, that passes; null if none does."""
    return F.get(F.filter(spans, test), F.lit(0))


def of_stage(spans: Column, stage: str) -> Column:
    return first_span(spans, lambda s: s["stage"] == stage)


def on_first(spans: Column, test: Callable[[Column], Column], then: Callable[[Column], Column]) -> Column:
    """``then`` of the first span that passes, which is looked for once however often ``then`` names it; null if none does."""
    return F.get(F.transform(F.slice(F.filter(spans, test), 1, 1), then), F.lit(0))


def on_stage(spans: Column, stage: str, then: Callable[[Column], Column]) -> Column:
    return on_first(spans, lambda s: s["stage"] == stage, then)


def scores(span: Column) -> Column:
    return F.coalesce(span["attrs"]["hit_scores"], F.array().cast("array<double>"))


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(values), F.lit(0))


def evidence(span: Column, key: str, value: Column, note: Column | str | None = None) -> Column:
    note = F.lit(note) if note is None or isinstance(note, str) else note
    return F.struct(span["span_id"].alias("span_id"), span["stage"].alias("stage"), F.lit(key).alias("key"), value.cast("string").alias("value"), note.cast("string").alias("note"))


def verdict(when: Column, taxonomy_id: str, stage: Column | str, confidence: float, *found: Column, source: str = "rule") -> Column:
    stage = F.lit(stage) if isinstance(stage, str) else stage
    return F.when(when, F.struct(F.lit(taxonomy_id).alias("taxonomy_id"), stage.alias("stage"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"), F.array(*found).alias("evidence")))


def timeout(spans: Column, limits: Limits) -> Column:
    return on_first(spans, lambda x: x["status"] == "timeout", lambda s: verdict(F.lit(True), "F-INFRA-001", s["stage"], 0.95, evidence(s, "status", s["status"]), evidence(s, "duration_ms", F.format_string("%.0f", s["duration_ms"]))))


def tool_error(spans: Column, limits: Limits) -> Column:
    return on_first(spans, lambda x: (x["stage"] == "tool") & (x["status"] == "error"), lambda s: verdict(F.lit(True), "F-TOOL-001", "tool", 0.90, evidence(s, "error", clip(s["attrs"]["error"], 160))))


def empty_retrieval(spans: Column, limits: Limits) -> Column:
    return on_stage(spans, "retrieve", lambda s: verdict((F.coalesce(s["attrs"]["hit_count"], F.lit(0)) == 0) & (F.size(scores(s)) == 0), "F-RET-001", "retrieve", 0.95, evidence(s, "hit_count", F.coalesce(s["attrs"]["hit_count"], F.lit(0))), evidence(s, "query", clip(s["attrs"]["query"], 160))))


def weak_retrieval(spans: Column, limits: Limits) -> Column:
    def of(s: Column) -> Column:
        mean = F.coalesce(s["attrs"]["mean_hit_score"], mean_of(scores(s)))
        return verdict((F.size(scores(s)) > 0) & (mean < limits.low_score), "F-RET-002", "retrieve", 0.85, evidence(s, "mean_hit_score", F.format_string("%.3f", mean), f"below {limits.low_score}"))

    return on_stage(spans, "retrieve", of)


def full_prompt(spans: Column, limits: Limits) -> Column:
    def of(s: Column) -> Column:
        a = s["attrs"]
        return verdict((a["finish_reason"] == "length") & (a["prompt_chars"] >= limits.context_share * limits.context_chars), "F-PROMPT-001", "generate", 0.90, evidence(s, "finish_reason", a["finish_reason"]), evidence(s, "prompt_chars", a["prompt_chars"]))

    return on_stage(spans, "generate", of)


@F.pandas_udf(StringType())
def json_error(text: pd.Series) -> pd.Series:
    """What is wrong with a JSON text, or null; only rows that should be JSON reach it."""

    def wrong(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            json.loads(t)
        except (ValueError, RecursionError) as e:
            return f"{getattr(e, 'msg', 'nested too deeply')} (char {getattr(e, 'pos', 0)})"
        return None

    return text.map(wrong).astype(object).where(lambda x: x.notna(), None)


def malformed_json(spans: Column, limits: Limits) -> Column:
    """The error text is found beforehand (``json_error`` over ``json_candidate``) and stands in column ``__json_error``."""
    s = of_stage(spans, "generate")
    return verdict(F.col("__json_error").isNotNull(), "F-GEN-001", "generate", 0.90, evidence(s, "output", clip(s["attrs"]["output"], 160), F.col("__json_error")))


def json_candidate(spans: Column) -> Column:
    """The output that should be JSON, or null."""
    a = of_stage(spans, "generate")["attrs"]
    starts = F.ltrim(a["output"]).substr(1, 1).isin("{", "[")
    return F.when((F.trim(a["output"]) != "") & (F.coalesce(a["output_format"] == "json", F.lit(False)) | starts), a["output"])


def repetition(spans: Column, limits: Limits) -> Column:
    def of(s: Column) -> Column:
        most = F.when(F.length(s["attrs"]["output"]) >= 80, repeated_trigrams(s["attrs"]["output"]))
        return F.transform(F.array(most), lambda n: verdict(n >= limits.repeats, "F-GEN-002", "generate", 0.90, evidence(s, "repeats", n)))[0]

    return on_stage(spans, "generate", of)


def declined(spans: Column, limits: Limits) -> Column:
    def of(s: Column) -> Column:
        phrase = refusal(s["attrs"]["output"]) if limits.refusals == REFUSALS else F.get(F.filter(F.array(*map(F.lit, limits.refusals)), lambda p: F.contains(F.lower(s["attrs"]["output"]), p)), F.lit(0))
        on = lambda r: verdict(phrase.isNotNull() & (mean_of(scores(r)) >= limits.low_score), "F-GEN-003", "generate", 0.80, evidence(s, "refusal", phrase), evidence(r, "mean_hit_score", F.format_string("%.3f", mean_of(scores(r)))))
        return F.when(phrase.isNotNull(), on_stage(spans, "retrieve", on))

    return on_stage(spans, "generate", of)


def cost_spike(spans: Column, limits: Limits) -> Column:
    """Against column ``__cost_limit``, which comes from the cohort."""
    s = F.coalesce(of_stage(spans, "generate"), F.get(spans, F.lit(0)))
    return verdict(F.col("total_cost") > F.col("__cost_limit"), "F-INFRA-002", "generate", 0.85, evidence(s, "total_cost", F.format_string("%.4f", F.col("total_cost"))))


#: The order decides: the first rule that fires names the failure.
RULES: tuple[Rule, ...] = (timeout, tool_error, empty_retrieval, weak_retrieval, full_prompt, malformed_json, repetition, declined, cost_spike)


def ambiguity(spans: Column) -> Column:
    """Sorted signals that something is off although no rule fired."""
    span_error = F.exists(spans, lambda s: (s["stage"] != "tool") & (s["status"] == "error"))
    blocked = F.exists(spans, lambda s: (s["stage"] == "guard") & F.coalesce(s["attrs"]["blocked"], F.lit(False)))
    blank = F.exists(spans, lambda s: (s["stage"] == "generate") & (s["status"] == "ok") & (F.trim(F.coalesce(s["attrs"]["output"], F.lit(""))) == ""))
    pairs = ((blank, "empty_output"), (blocked, "guard_blocked"), (span_error, "span_error"))
    return F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in pairs)), lambda x: x.isNotNull())


def fallback(spans: Column) -> Column:
    """A verdict from the ambiguity signals alone."""
    signals = ambiguity(spans)
    has = lambda name: F.array_contains(signals, name)
    bad = first_span(spans, lambda s: s["status"] == "error")
    guard = of_stage(spans, "guard")
    return F.coalesce(
        verdict(has("guard_blocked"), "F-INFRA-003", "guard", 0.45, evidence(guard, "blocked", guard["attrs"]["blocked"]), source="fallback"),
        verdict(has("span_error") & (bad["stage"] == "tool"), "F-TOOL-001", "tool", 0.45, evidence(bad, "status", bad["status"]), source="fallback"),
        verdict(has("span_error"), "F-INFRA-003", bad["stage"], 0.45, evidence(bad, "status", bad["status"]), source="fallback"),
        verdict(has("empty_output"), "F-GEN-001", "generate", 0.45, evidence(of_stage(spans, "generate"), "output", F.lit("")), source="fallback"),
    )
