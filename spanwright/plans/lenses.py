"""Views of the driver's tables as traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..keeping import keep
from ..schema import ATTR_NAMES, SPAN

__all__ = ["conversation_answers", "event_spans", "event_traces", "keep", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace for each user and day: their events in order."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.to_date("ts").alias("day"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    stage = F.create_map(*(F.lit(x) for kv in {"signup": "embed", "view": "retrieve", "click": "rerank", "purchase": "generate", "error": "tool"}.items() for x in kv))
    pos = F.row_number().over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id")) - 1
    status = F.when(F.col("value") > 200, "timeout").when(F.col("event_type") == "error", "error").otherwise("ok")
    return e.select(F.concat_ws("-", "user_id", "day").alias("trace_id"), "ts", "day", "event_id", "k", pos.alias("pos"), stage[F.col("event_type")].alias("stage"), status.alias("status"), F.col("value").alias("duration_ms"), (F.col("value") / 1000).alias("cost"), F.col("event_type").alias("name"))


def event_traces(spark: SparkSession, sf_dir: str, top_k: int = 20) -> DataFrame:
    k, stage = F.col("k"), F.col("stage")
    known = {
        "hit_count": F.when(stage == "retrieve", k), "hit_scores": F.when(stage == "retrieve", F.when(k > 0, F.array(k / 100)).otherwise(F.array())), "top_k": F.when(stage == "retrieve", F.lit(top_k)),
        "rerank_delta": F.when(stage == "rerank", (k - 50) / 100), "token_count": F.when(stage == "embed", k),
    }
    attrs = F.struct(*(known.get(n, F.lit(None)).alias(n) for n in ATTR_NAMES))
    span = F.struct("pos", F.col("event_id").cast("string").alias("span_id"), F.lit(None).alias("parent_id"), "name", "stage", "duration_ms", "status", k.alias("tokens_in"), F.lit(0).alias("tokens_out"), "cost", attrs.alias("attrs")).cast(f"struct<{SPAN}>")
    spans = event_spans(spark, sf_dir).select("trace_id", "ts", "day", "cost", span.alias("s"))
    by_pos = lambda a, b: a["pos"] - b["pos"]
    rows = spans.groupBy("trace_id", "day").agg(F.min("ts").alias("ts"), F.array_sort(F.collect_list("s"), by_pos).alias("spans"))
    return rows.select("trace_id", F.col("ts").cast("timestamp").alias("ts"), "day", F.lit("events").alias("pipeline_name"), F.aggregate("spans", F.lit(0.0), lambda a, s: a + s["cost"]).alias("total_cost"), "spans")


def conversation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, output, context: each answer with the user's text before it."""
    c = table(spark, sf_dir, "conversations")
    before = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    return c.withColumn("context", before).where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("output"), "context")
