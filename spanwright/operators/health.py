"""Health cards: how each stage of a pipeline does over a cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import mean_of, of_stage, scores
from ..functions.stats import mean_or_zero
from ..functions.text import groundedness
from ..schema import STAGES
from .order import percentiles


def spans_of(traces: DataFrame) -> DataFrame:
    """One row for each span, with its trace's id, time and day."""
    return traces.select("trace_id", "ts", "day", F.explode("spans").alias("s")).select("trace_id", "ts", "day", "s.*")


def status(error_rate: Column, warn: float = 0.05, crit: float = 0.2) -> Column:
    return F.when(error_rate >= crit, "crit").when(error_rate >= warn, "warn").otherwise("ok")


def stage_cards(spans: DataFrame) -> DataFrame:
    """stage, n, p50_ms, p95_ms, error_rate, status; agents have no card."""
    spans = spans.where(F.col("stage") != "agent")
    cards = spans.groupBy("stage").agg(F.count("*").alias("n"), F.avg(F.when(F.col("status") != "ok", 1.0).otherwise(0.0)).alias("error_rate"))
    times = percentiles(spans, F.col("duration_ms"), {"p50_ms": 50.0, "p95_ms": 95.0}, ("stage",))
    cards = cards.join(times, "stage", "left")  # a row for each stage
    return cards.select("stage", "n", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p50_ms", "p95_ms")), "error_rate", status(F.col("error_rate")).alias("status"))


def retrieve_card(traces: DataFrame) -> DataFrame:
    """hit_rate, mean_score (of traces with scores) and k_coverage over the first retrieval of each trace."""
    s = traces.select(of_stage(F.col("spans"), "retrieve").alias("s")).where("s is not null")
    k = F.nullif(F.col("s.attrs.top_k"), F.lit(0))
    hits = F.coalesce(F.nullif(F.col("s.attrs.hit_count"), F.lit(0)), F.size(scores(F.col("s"))))
    return s.agg(
        F.avg(F.when(hits > 0, 1.0).otherwise(0.0)).alias("hit_rate"), mean_or_zero(mean_of(scores(F.col("s")))).alias("mean_score"),
        mean_or_zero(F.least(F.lit(1.0), hits / k)).alias("k_coverage"), F.count("*").alias("n"),
    )


def rerank_card(spans: DataFrame) -> DataFrame:
    return spans.where("stage = 'rerank'").agg(mean_or_zero(F.coalesce("attrs.rerank_delta", F.lit(0.0))).alias("mean_delta"), F.count("*").alias("n"))


def embed_card(spans: DataFrame) -> DataFrame:
    t = F.coalesce("attrs.token_count", F.lit(0.0))
    return spans.where("stage = 'embed'").agg(mean_or_zero(t).alias("mean_tokens"), F.coalesce(F.stddev_pop(t), F.lit(0.0)).alias("std_tokens"), F.count("*").alias("n"))


def generate_card(spans: DataFrame) -> DataFrame:
    """Mean and lower quartile of groundedness over outputs that are not blank."""
    a = spans.where("stage = 'generate' and trim(attrs.output) <> ''").select(groundedness(F.col("attrs.output"), F.col("attrs.context")).alias("g"))
    low = percentiles(a, F.col("g"), {"groundedness_p25": 25.0})
    card = a.agg(mean_or_zero(F.col("g")).alias("groundedness"), F.count("*").alias("n")).join(low, how="left")  # one row each
    return card.select("groundedness", F.coalesce("groundedness_p25", F.lit(0.0)).alias("groundedness_p25"), "n")


def worst(*statuses: Column) -> Column:
    """The worst of ok, warn and crit; a null one does not count."""
    order = F.array(F.lit("ok"), F.lit("warn"), F.lit("crit"))
    return F.element_at(order, F.greatest(F.lit(1), *(F.array_position(order, s) for s in statuses)).cast("int"))


def below(value: Column, warn: float, crit: float) -> Column:
    return F.when(value < crit, "crit").when(value < warn, "warn").otherwise("ok")


def report_cards(traces: DataFrame, low_score: float = 0.6, grounded_warn: float = 0.6, grounded_crit: float = 0.35) -> DataFrame:
    """stage, n, p50_ms, p95_ms, error_rate, metrics (map), status, flags of each stage that occurs, in the order of stages; agents have no card.

    Only a hit rate below 0.9, a mean score below ``low_score``, a rerank gain below 0.01 and groundedness below
    ``grounded_warn`` lower a status; errors do not.
    """
    spans = spans_of(traces)
    own = stage_cards(spans).drop("status")
    own = own.select("stage", "n", *(F.round(c, d).alias(c) for c, d in (("p50_ms", 2), ("p95_ms", 2), ("error_rate", 4))))

    def card(stage: str, rows: DataFrame, metrics: dict[str, Column], *checks: tuple[Column, Column, str]) -> DataFrame:
        named = F.create_map(*(x for k, v in metrics.items() for x in (F.lit(k), v.cast("double"))))
        flags = F.filter(F.array(*(F.when(fails, flag) for fails, _, flag in checks)).cast("array<string>"), lambda x: x.isNotNull())
        state = worst(*(F.when(fails, s) for fails, s, _ in checks), F.lit("ok"))
        return rows.where("n > 0").select(F.lit(stage).alias("stage"), named.alias("metrics"), state.alias("status"), flags.alias("flags"))

    hit, mean, gain, grounded = F.col("hit_rate"), F.col("mean_score"), F.round("mean_delta", 4), F.round("groundedness", 4)
    extra = card("retrieve", retrieve_card(traces), {"hit_rate": F.round(hit, 4), "mean_hit_score": F.round(mean, 4), "k_coverage": F.round("k_coverage", 4)}, (hit < 0.9, below(hit, 0.9, 0.7), "queries without hits"), (mean < low_score, below(mean, 0.6, 0.45), "weak context"))
    extra = extra.unionByName(card("rerank", rerank_card(spans), {"mean_rerank_delta": gain}, (gain < 0.01, F.lit("warn"), "reranking gains nothing")))
    # of several generations of a trace the first one counts; it stands in the trace's own row
    first = traces.select(of_stage(F.col("spans"), "generate").alias("s")).where("s is not null").select("s.*")
    extra = extra.unionByName(card("generate", generate_card(first), {"groundedness_mean": grounded, "groundedness_p25": F.round("groundedness_p25", 4)}, (grounded < grounded_warn, below(grounded, grounded_warn, grounded_crit), "answers leave their context")))
    extra = extra.unionByName(card("embed", embed_card(spans), {"token_count_mean": F.round("mean_tokens", 1), "token_count_std": F.round("std_tokens", 1)}))
    rows = own.join(F.broadcast(extra), "stage", "left")  # a row for each stage
    return rows.select("stage", "n", "p50_ms", "p95_ms", "error_rate", "metrics", F.coalesce("status", F.lit("ok")).alias("status"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags")).orderBy(stage_order(F.col("stage")))


def measures(spans: Column) -> dict[str, Column]:
    """What a replay compares: mean score of the first retrieval, groundedness of the first generation, gain of the first rerank; null where a trace has no such span."""
    retrieved, written, ranked = (of_stage(spans, x) for x in ("retrieve", "generate", "rerank"))
    return {
        "mean_hit_score": F.when(retrieved.isNotNull(), F.round(F.coalesce(mean_of(scores(retrieved)), F.lit(0.0)), 4)),
        "groundedness": F.when(written.isNotNull(), F.round(groundedness(written["attrs"]["output"], written["attrs"]["context"]), 4)),
        "rerank_delta": F.when(ranked.isNotNull(), F.coalesce(ranked["attrs"]["rerank_delta"], F.lit(0.0))),
    }


def trace_health(traces: DataFrame) -> DataFrame:
    """A snapshot of each trace: total and slowest duration, errors, mean score of its first retrieval, cost, and the ``measures``."""
    s = F.col("spans")
    return traces.select(
        "trace_id", F.aggregate(s, F.lit(0.0), lambda a, x: a + x["duration_ms"]).alias("total_ms"), F.array_max(F.transform(s, lambda x: x["duration_ms"])).alias("slowest_ms"),
        F.size(F.filter(s, lambda x: x["status"] != "ok")).alias("errors"), mean_of(scores(of_stage(s, "retrieve"))).alias("mean_score"), F.col("total_cost"),
        *(v.alias(n) for n, v in measures(s).items()),
    )


def stage_order(stage: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, STAGES)), stage), F.lit(99))
