"""Traces from JSON: native traces, bare spans, evaluation records and observation pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stages import normalize_stage, parse_time
from ..keeping import settled
from ..schema import ATTRS, SPAN, TRACES


class IngestError(ValueError):
    """A source that gives no trace at all."""


_SPAN_IN = f"span_id string, id string, parent_id string, name string, stage string, duration_ms double, durationMs double, status string, tokens_in bigint, tokensIn bigint, tokens_out bigint, tokensOut bigint, cost double, attrs struct<{ATTRS}>"
_RECORD = (
    f"trace_id string, id string, ts string, timestamp string, pipeline_name string, name string, total_cost double, spans array<struct<{_SPAN_IN}>>, "
    "query string, question string, retrieved array<string>, hits array<string>, top_k int, answer string, output string, context string, retrieval_ms double, generation_ms double, prompt_chars int, "
    f"span_id string, parent_id string, stage string, duration_ms double, durationMs double, status string, tokens_in bigint, tokensIn bigint, tokens_out bigint, tokensOut bigint, cost double, attrs struct<{ATTRS}>"
)


def _span(s: Column, i: Column) -> Column:
    status = F.lower(F.trim(F.coalesce(s["status"], F.lit("ok"))))
    name = F.coalesce(s["name"], s["stage"], F.lit("span"))
    return F.struct(
        i.cast("int").alias("pos"), F.coalesce(s["span_id"], s["id"], F.concat_ws("-", name, i.cast("string"))).alias("span_id"), s["parent_id"].alias("parent_id"), name.alias("name"),
        normalize_stage(F.coalesce(s["stage"], name)).alias("stage"), F.coalesce(s["duration_ms"], s["durationMs"], F.lit(0.0)).alias("duration_ms"),
        F.when(status.isin("ok", "error", "timeout"), status).when(status == "", "ok").otherwise("error").alias("status"), F.coalesce(s["tokens_in"], s["tokensIn"], F.lit(0)).alias("tokens_in"),
        F.coalesce(s["tokens_out"], s["tokensOut"], F.lit(0)).alias("tokens_out"), F.coalesce(s["cost"], F.lit(0.0)).alias("cost"), s["attrs"].alias("attrs"),
    ).cast(f"struct<{SPAN}>")


def _attrs(**known: Column) -> Column:
    names = [x.split()[0] for x in ATTRS.split(", ")]
    return F.struct(*(known.get(n, F.lit(None)).alias(n) for n in names)).cast(f"struct<{ATTRS}>")


def _evaluation(r: Column, trace_id: Column) -> Column:
    """A retrieve span and a generate span from an evaluation record; hits without a score do not count."""
    hits = F.coalesce(r["retrieved"], r["hits"], F.array().cast("array<string>"))
    score = F.filter(F.transform(hits, lambda h: F.coalesce(h.try_cast("double"), F.get_json_object(h, "$.score").try_cast("double"))), lambda x: x.isNotNull())
    answer = F.coalesce(r["answer"], r["output"], F.lit(""))
    query = F.coalesce(r["query"], r["question"])
    base = {"status": F.lit("ok"), "tokens_in": F.lit(0), "tokens_out": F.lit(0), "cost": F.lit(0.0)}
    own = lambda stage: F.concat(trace_id, F.lit(f"-{stage}"))

    def span(pos: int, stage: str, name: str, parent: Column, ms: Column, attrs: Column) -> Column:
        return F.struct(
            F.lit(pos).alias("pos"), own(stage).alias("span_id"), parent.alias("parent_id"), F.lit(name).alias("name"), F.lit(stage).alias("stage"),
            F.coalesce(ms, F.lit(0.0)).alias("duration_ms"), *(v.alias(k) for k, v in base.items()), attrs.alias("attrs"),
        ).cast(f"struct<{SPAN}>")

    return F.array(
        span(0, "retrieve", "hybrid_retrieve", F.lit(None), r["retrieval_ms"], _attrs(query=query, top_k=F.coalesce(F.nullif(r["top_k"], F.lit(0)), F.size(score)), hit_count=F.size(score), hit_scores=score)),
        span(1, "generate", "generate", own("retrieve"), r["generation_ms"], _attrs(output=answer, context=F.coalesce(r["context"], F.lit("")), prompt_chars=F.coalesce(r["prompt_chars"], 4 * F.length(answer)))),
    )


def parse_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Traces with meta (JSON, or null), and rejects (line, reason), from ``lines`` (line: number, value: a JSON object as text).

    Has spans: a trace. Has query or question: an evaluation record, whose metrics are in meta. Else: one span that is a trace of its own.
    Blank lines are passed over. A line is rejected if it is not a JSON object, if its spans are not a list of objects, or if its time
    cannot be read; a record without an id is called after its line.
    """
    get = lambda key: F.get_json_object("value", f"$.{key}")
    rows = settled(lines.select("line", "value")).where(F.trim("value") != "").select(
        "line", F.from_json("value", _RECORD, {"mode": "PERMISSIVE"}).alias("r"), get("spans").alias("spans"), get("meta").alias("meta"), get("metrics").alias("metrics"),
        F.try_parse_json("value").isNotNull().alias("valid"), F.ltrim("value").startswith("{").alias("object"),
    )
    r = F.col("r")
    raw = F.coalesce(r["ts"], r["timestamp"])
    ts = F.when(F.coalesce(F.trim(raw), F.lit("0")).isin("0", "0.0", ""), F.timestamp_micros(F.lit(0))).otherwise(parse_time(raw))
    items = F.from_json("spans", "array<string>")
    off = items.isNull() | F.exists(items, lambda x: ~F.coalesce(F.ltrim(x).startswith("{"), F.lit(False)))
    reason = F.when(~F.col("valid"), "not JSON").when(~F.col("object"), "not an object").when(F.col("spans").isNotNull() & off, "spans are not a list of objects").when(ts.isNull(), "a time that cannot be read")
    rows = settled(settled(rows).select("line", "r", "spans", "meta", "metrics", reason.alias("reason"), ts.alias("ts")))
    bad = rows.where("reason is not null").select("line", "reason")
    good = rows.where("reason is null")
    native, evaluated = F.col("spans").isNotNull(), r["query"].isNotNull() | r["question"].isNotNull()
    trace_id = F.coalesce(r["trace_id"], F.when(native | evaluated, r["id"]), F.concat(F.lit("trace-l"), F.col("line").cast("string")))
    spans = F.when(native, F.transform(r["spans"], _span)).when(evaluated, _evaluation(r, trace_id)).otherwise(F.array(_span(r, F.lit(0))))
    metrics = F.concat(F.lit('{"metrics": '), F.coalesce("metrics", F.lit("{}")), F.lit(', "source": "evaluation"}'))
    meta = F.when(native, F.col("meta")).when(evaluated, metrics)
    out = good.select("r", trace_id.alias("trace_id"), "ts", spans.alias("own"), meta.alias("meta"), F.when(native, r["total_cost"]).alias("total_cost"), native.alias("native"))
    cost = F.aggregate(F.col("own"), F.lit(0.0), lambda a, s: a + s["cost"])
    traces = out.select(
        "trace_id", "ts", F.to_date("ts").alias("day"), F.coalesce(r["pipeline_name"], F.when(F.col("native"), r["name"]), F.lit("unknown")).alias("pipeline_name"),
        F.when(F.coalesce("total_cost", F.lit(0.0)) == 0, cost).otherwise(F.col("total_cost")).alias("total_cost"), F.col("own").alias("spans"), "meta",
    )
    return traces.select(*(F.col(c) for c in ("trace_id", "ts", "day", "pipeline_name", "total_cost", "spans", "meta"))), bad


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1 in each file), value of text files, however they are split over tasks."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a row for each part of a file
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "start", "first", before.alias("before"))
    return rows.join(blocks, ["file", "start"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def _schema():
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(TRACES)


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Traces and rejects of JSON Lines files, by their lines."""
    return parse_records(numbered(spark, path))


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Traces and rejects of JSON documents, each an object or an array of objects."""
    whole = spark.read.text(path, wholetext=True)
    kinds = F.ltrim("value").startswith("[")
    parts = whole.select(F.posexplode(F.when(kinds, F.from_json("value", "array<string>")).otherwise(F.array("value"))).alias("line", "value"))
    return parse_records(parts.select(F.col("line").cast("long").alias("line"), F.coalesce("value", F.lit("null")).alias("value")))


def load(spark: SparkSession, path: str) -> DataFrame:
    """Traces of a path by its ending; a source without any trace is an error."""
    traces, bad = (read_jsonl if path.endswith((".jsonl", ".ndjson")) else read_json)(spark, path)
    if not traces.head(1):
        first = bad.orderBy("line").head(1)
        raise IngestError(f"no trace in {path}" + (f": line {first[0]['line']}, {first[0]['reason']}" if first else ""))
    return traces


def from_pages(traces: DataFrame, observations: DataFrame) -> DataFrame:
    """Traces from exported pages: ``traces`` (id, timestamp, name), ``observations`` (id, traceId, name, type, level, startTime, endTime, tokens_in, tokens_out, cost, page_pos)."""
    ms = F.greatest(F.lit(0.0), (F.unix_micros("endTime") - F.unix_micros("startTime")) / 1000)
    status = F.when(F.lower("name").contains("timeout"), "timeout").when(F.col("level") == "ERROR", "error").otherwise("ok")
    span = F.struct(
        F.lit(0).alias("pos"), F.col("id").alias("span_id"), F.lit(None).alias("parent_id"), F.col("name"), normalize_stage(F.coalesce("name", "type")).alias("stage"), F.coalesce(ms, F.lit(0.0)).alias("duration_ms"),
        status.alias("status"), F.coalesce("tokens_in", F.lit(0)).alias("tokens_in"), F.coalesce("tokens_out", F.lit(0)).alias("tokens_out"), F.coalesce("cost", F.lit(0.0)).alias("cost"), _attrs().alias("attrs"),
    ).cast(f"struct<{SPAN}>")
    own = observations.groupBy(F.col("traceId").alias("trace_id")).agg(F.array_sort(F.collect_list(F.struct("page_pos", F.col("id").alias("oid"), span.alias("s"))), lambda a, b: F.when(a["page_pos"] < b["page_pos"], -1).when(a["page_pos"] > b["page_pos"], 1).otherwise(0)).alias("o"))
    rows = traces.select(F.col("id").alias("trace_id"), F.col("timestamp").alias("ts"), F.coalesce("name", F.lit("unknown")).alias("pipeline_name")).join(own, "trace_id", "left")
    spans = F.coalesce(F.transform("o", lambda x, i: x["s"].withField("pos", i)), F.array().cast(f"array<struct<{SPAN}>>"))
    ts = F.coalesce("ts", F.current_timestamp())
    rows = rows.select("trace_id", ts.alias("ts"), F.to_date(ts).alias("day"), "pipeline_name", spans.alias("spans"))
    return rows.withColumn("total_cost", F.aggregate("spans", F.lit(0.0), lambda a, s: a + s["cost"])).select("trace_id", "ts", "day", "pipeline_name", "total_cost", "spans").to(_schema())
