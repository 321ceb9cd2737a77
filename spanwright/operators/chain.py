"""Causal chain of a failure: where it began, what it met, and what stood downstream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import first_span, of_stage, scores


def begins(spans: Column, failed: Column, seen: Column) -> Column:
    """Position of the span ``seen`` of the first evidence; without it that of the first span of the failed stage; else null."""
    return F.coalesce(first_span(spans, lambda s: s["span_id"] == seen), of_stage(spans, failed))["pos"]


def blast(spans: Column, begins: Column, failed: Column) -> Column:
    """downstream, stages (sorted), cost, user_facing: what came after position ``begins``; nothing if that is null."""
    after = F.filter(spans, lambda s: F.coalesce(s["pos"] > begins, F.lit(False)))
    stages = F.array_sort(F.array_distinct(F.transform(after, lambda s: s["stage"])))
    return F.struct(
        F.size(after).alias("downstream"), stages.alias("stages"), F.aggregate(after, F.lit(0.0), lambda a, s: a + s["cost"]).alias("cost"),
        (F.exists(after, lambda s: s["stage"] == "generate") | (failed == "generate")).alias("user_facing"),
    )


def blast_radius(traces: DataFrame, failures: DataFrame) -> DataFrame:
    """trace_id, downstream, stages, cost, user_facing: what came after the span of the first evidence.

    Where the trace has no such span, after the first span of the failed stage; where it has neither, nothing.
    """
    seen = F.get(F.col("evidence"), F.lit(0))["span_id"]
    rows = traces.join(failures.select("trace_id", F.col("stage").alias("failed"), seen.alias("seen")), "trace_id")
    rows = rows.withColumn("begins", begins(F.col("spans"), F.col("failed"), F.col("seen"))).withColumn("b", blast(F.col("spans"), F.col("begins"), F.col("failed")))
    return rows.select("trace_id", "b.downstream", F.array_join("b.stages", ",").alias("stages"), "b.cost", "b.user_facing")


def poisoning(traces: DataFrame) -> DataFrame:
    """trace_id, min_score, mean_score of the first retrieval with scores."""
    s = scores(of_stage(F.col("spans"), "retrieve"))
    rows = traces.select("trace_id", s.alias("s")).where(F.size("s") > 0)
    return rows.select("trace_id", F.array_min("s").alias("min_score"), (F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / F.size("s")).alias("mean_score"))


def trigger(traces: DataFrame, failures: DataFrame) -> DataFrame:
    """trace_id, span_id, key, value: the first evidence of each failure."""
    return failures.where(F.size("evidence") > 0).select("trace_id", F.col("evidence")[0].alias("e")).select("trace_id", "e.span_id", "e.key", "e.value")
