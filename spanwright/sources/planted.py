"""Traces with planted failures and their truth, to score the operators against.

Every draw is a hash of the seed, the request's day and number, and the name of the draw: the same request gets the same trace in
any partitioning and beside any other requests, and a corpus of any size is one projection over ``requests``. From ``DRIFT_DAY``
on more retrievals fail, and the scores of healthy ones sag.

    traces = planted.corpus(spark, seed=42)
    truth = planted.truth(traces)
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ATTR_NAMES, SPAN, TAXONOMY

#: Share of requests with each failure before the drift and from its first day on.
PLAN = (
    ("F-RET-001", 0.12, 0.18),
    ("F-RET-002", 0.08, 0.28),
    ("F-PROMPT-001", 0.06, 0.06),
    ("F-GEN-001", 0.05, 0.05),
    ("F-GEN-002", 0.04, 0.04),
    ("F-GEN-003", 0.03, 0.03),
    ("F-INFRA-001", 0.02, 0.02),
    ("F-INFRA-002", 0.02, 0.02),
)
DRIFT_DAY = 15
CONTEXT_CHARS = 8192
TOP_K = 5
#: Digits of a hash that make a draw: 52 bits, exact in a double.
DIGITS = 13

QUESTIONS = ("When does the north lock open?", "Which barge carries the gravel?", "How deep is the mill basin?", "Who signs the winter timetable?", "What does a night passage cost?")
#: A passage and an answer that it supports.
FACTS = (
    ("The north lock opens at 06:30 from April to October. Skippers report to the keeper by radio on channel 22.", "The north lock opens at 06:30 from April to October."),
    ("The barge Amalia carries gravel from the Teufen quarry. She loads 310 tonnes and passes the lock on Tuesdays.", "The barge Amalia carries gravel from the Teufen quarry and loads 310 tonnes."),
    ("The mill basin is 4 metres deep after dredging. The harbour office signs the winter timetable in November.", "The mill basin is 4 metres deep, and the harbour office signs the winter timetable."),
)
STRAY = ("Painters renewed the signs along the towpath in spring.", "The museum shows ropes, lamps and models of tugs.")
INVENTED = "The ferry to Lindau costs 90 francs and leaves at noon."
REFUSED = "I cannot answer that question from the context that I was given."
REPEATED = "The lock opens at dawn. "


def draw(seed: int, name: str) -> Column:
    """A number from 0 to 1 of the request (columns ``day_no`` and ``number``)."""
    text = F.concat_ws("/", F.lit(str(seed)), F.col("day_no").cast("string"), F.col("number").cast("string"), F.lit(name))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long") / float(16**DIGITS)


def thresholds() -> list[tuple[str, float, float]]:
    """Class and the draws below which it falls, before and after the drift."""
    out, before, after = [], 0.0, 0.0
    for name, p, q in PLAN:
        before, after = round(before + p, 6), round(after + q, 6)
        out.append((name, before, after))
    return out


def planted_class(seed: int, drift_day: int = DRIFT_DAY) -> Column:
    """The failure of a request; null for a healthy one."""
    u, after = draw(seed, "failure"), F.col("day_no") >= drift_day
    return F.coalesce(*(F.when(u < F.when(after, q).otherwise(p), F.lit(name)) for name, p, q in thresholds()))


def requests(spark: SparkSession, days: int = 28, per_day: int = 20, start: dt.datetime = dt.datetime(2026, 8, 1, 6, tzinfo=dt.UTC)) -> DataFrame:
    """day_no (from 1), number (from 0 in each day), trace_id, ts."""
    if days < 3:
        raise ValueError("at least 3 days are needed")
    rows = spark.range(days * per_day).select((F.expr(f"id div {per_day}") + 1).alias("day_no"), (F.col("id") % per_day).alias("number"))
    at = F.lit(int(start.timestamp())) + (F.col("day_no") - 1) * 86_400 + F.col("number") * F.lit(64_800 // per_day)
    return rows.select("day_no", "number", F.concat(F.lit("t-"), F.lpad(F.col("day_no").cast("string"), 3, "0"), F.lit("-"), F.lpad(F.col("number").cast("string"), 6, "0")).alias("trace_id"), F.timestamp_seconds(at).alias("ts"))


def plant(rows: DataFrame, seed: int = 42, drift_day: int = DRIFT_DAY, pipeline: str = "harbour-desk") -> DataFrame:
    """A trace for each request (day_no, number, trace_id, ts), with day_no and ``planted``: its failure, or null."""

    def between(name: str, low: Column | float, high: Column | float) -> Column:
        return draw(seed, name) * (high - low) + low

    def whole(name: str, low: int, high: int) -> Column:
        return F.floor(between(name, low, high + 1)).cast("long")

    def one_of(name: str, texts: tuple[str, ...]) -> Column:
        return F.array(*map(F.lit, texts))[F.floor(draw(seed, name) * len(texts)).cast("int")]

    def span(stage: str, name: str, parent: str | None, ms: Column, status: Column | str = "ok", tokens_in: Column | int = 0, tokens_out: Column | int = 0, cost: Column | float = 0.0, **attrs: Column) -> Column:
        of = lambda x: x if isinstance(x, Column) else F.lit(x)
        own = F.concat_ws("-", "trace_id", F.lit(stage))
        return F.struct(
            F.lit(0).alias("pos"), own.alias("span_id"), (F.concat_ws("-", "trace_id", F.lit(parent)) if parent else F.lit(None)).alias("parent_id"), F.lit(name).alias("name"), F.lit(stage).alias("stage"), F.round(ms, 2).alias("duration_ms"),
            of(status).alias("status"), of(tokens_in).alias("tokens_in"), of(tokens_out).alias("tokens_out"), of(cost).alias("cost"), F.struct(*(attrs.get(n, F.lit(None)).alias(n) for n in ATTR_NAMES)).alias("attrs"),
        ).cast(f"struct<{SPAN}>")

    is_ = lambda *names: F.coalesce(F.col("planted").isin(*names), F.lit(False))
    rows = rows.withColumn("planted", planted_class(seed, drift_day))
    # what the spans share, drawn once
    sag = F.when(F.col("day_no") >= drift_day, 0.06).otherwise(0.0)
    low, high = F.when(is_("F-RET-002"), 0.30).otherwise(0.68 - sag), F.when(is_("F-RET-002"), 0.46).otherwise(0.94 - sag)
    found = F.when(is_("F-RET-001"), F.array().cast("array<double>")).otherwise(F.reverse(F.array_sort(F.array(*(F.round(between(f"score {k}", low, high), 3) for k in range(TOP_K))))))
    fact = F.array(*(F.struct(F.lit(c).alias("context"), F.lit(a).alias("answer")) for c, a in FACTS))[F.floor(draw(seed, "fact") * len(FACTS)).cast("int")]
    rows = rows.select("*", found.alias("__scores"), fact.alias("__fact"), whole("prompt", 2800, 5200).alias("__prompt"), whole("spike", 90_000, 150_000).alias("__spike"), between("gain", F.when(is_("F-RET-002"), 0.01).otherwise(0.04), F.when(is_("F-RET-002"), 0.05).otherwise(0.22)).alias("__gain"))
    mean = F.aggregate("__scores", F.lit(0.0), lambda a, x: a + x) / TOP_K

    def case(*of: tuple[str, Column], healthy: Column) -> Column:
        return F.coalesce(*(F.when(is_(name), value) for name, value in of), healthy)

    answer = F.col("__fact.answer")
    output = case(
        ("F-RET-001", F.lit(INVENTED)), ("F-PROMPT-001", F.expr("left(__fact.answer, length(__fact.answer) div 2)")), ("F-GEN-001", F.concat(F.lit('{"answer": "'), answer)),
        ("F-GEN-002", F.lit(REPEATED * 14)), ("F-GEN-003", F.lit(REFUSED)), ("F-INFRA-001", F.lit("")), healthy=answer,
    )
    generate = span(
        "generate", "answer", "retrieve", case(("F-INFRA-001", between("wait", 29_000, 42_000)), ("F-INFRA-002", between("wait", 4_000, 9_000)), healthy=between("wait", 500, 2_400)),
        status=F.when(is_("F-INFRA-001"), "timeout").otherwise("ok"), tokens_in=case(("F-PROMPT-001", whole("tokens", 1900, 2100)), ("F-INFRA-002", F.col("__spike")), healthy=F.col("__prompt") / 4).cast("long"),
        tokens_out=case(("F-PROMPT-001", whole("out", 60, 110)), ("F-GEN-001", whole("out", 30, 60)), ("F-GEN-002", whole("out", 500, 900)), ("F-GEN-003", whole("out", 25, 40)), ("F-INFRA-001", F.lit(0)), healthy=whole("out", 150, 380)),
        cost=F.round(F.when(is_("F-INFRA-002"), between("cost", 0.6, 1.4)).otherwise(between("cost", 0.0015, 0.0045)), 6), model=F.lit("small-8b"), output=output,
        prompt_chars=case(("F-PROMPT-001", whole("full", CONTEXT_CHARS - 40, CONTEXT_CHARS - 1)), ("F-INFRA-002", F.col("__spike") * 4), healthy=F.col("__prompt")), finish_reason=F.when(is_("F-PROMPT-001", "F-GEN-001"), "length").otherwise("stop"),
        context=case(("F-RET-001", F.lit("")), ("F-RET-002", one_of("stray", STRAY)), healthy=F.col("__fact.context")), output_format=F.when(is_("F-GEN-001"), "json"),
    )
    each = {
        "embed": span("embed", "embed", None, between("embed", 6, 18), token_count=whole("embedded", 20, 60), model=F.lit("embed-s")),
        "retrieve": span("retrieve", "hybrid_retrieve", "embed", between("retrieve", 25, 110), query=one_of("question", QUESTIONS), top_k=F.lit(TOP_K), hit_count=F.size("__scores"), hit_scores=F.col("__scores")),
        "rerank": F.when((F.size("__scores") > 0) & (draw(seed, "reranks") < 0.85), span("rerank", "rerank", "retrieve", between("rerank", 12, 45), rerank_top1=F.round(F.least(F.lit(0.99), mean + F.col("__gain")), 3), rerank_delta=F.round("__gain", 3))),
        "graph": F.when(draw(seed, "hops") < 0.15, span("graph", "graph_merge", "retrieve", between("graph", 30, 90))),
        "generate": generate,
        "guard": F.when(draw(seed, "guards") < 0.5, span("guard", "guardrails", "generate", between("guard", 2, 8), blocked=F.lit(False))),
        "tool": F.when(draw(seed, "calls") < 0.25, span("tool", "look_up", "generate", between("tool", 40, 300))),
    }
    # a column for each span: drawn by compiled code, and once; inside a lambda every draw would be interpreted
    rows = rows.select("*", *(s.alias(f"__{n}_span") for n, s in each.items()))
    own = [F.col(f"__{n}_span") for n in each]
    there = F.filter(F.array(*own), lambda s: s.isNotNull())
    numbered = F.transform(there, lambda s, i: s.withField("pos", i)).cast(f"array<struct<{SPAN}>>")
    total = F.round(sum((F.coalesce(s["cost"], F.lit(0.0)) for s in own), F.lit(0.0)), 6)
    return rows.select("trace_id", "ts", F.to_date("ts").alias("day"), F.lit(pipeline).alias("pipeline_name"), total.alias("total_cost"), numbered.alias("spans"), "day_no", "planted")


def corpus(spark: SparkSession, seed: int = 42, days: int = 28, per_day: int = 20) -> DataFrame:
    return plant(requests(spark, days, per_day), seed)


def truth(traces: DataFrame) -> DataFrame:
    """trace_id, taxonomy_id, stage (where the cause is), day_no of the planted failures."""
    stage = F.create_map(*(F.lit(x) for name, _, _ in PLAN for x in (name, TAXONOMY[name][1])))
    return traces.where("planted is not null").select("trace_id", F.col("planted").alias("taxonomy_id"), stage[F.col("planted")].alias("stage"), "day_no")


def write_lines(traces: DataFrame, path: str) -> None:
    """The traces, without the truth, as JSON lines that ``records.load`` reads."""
    traces.drop("planted", "day_no", "day").select(F.to_json(F.struct("*"))).write.text(path)
