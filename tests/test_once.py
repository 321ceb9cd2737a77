"""Costly values are made once for each row."""

from pyspark.sql import functions as F

from spanwright.functions.stages import normalize_stage
from spanwright.sources import otlp, records


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_stage_key_is_made_once(spark):
    names = spark.createDataFrame([("LLM",), (" Rerank ",), ("my retrieval step",), ("",), (None,)], "name string")
    found = names.select("name", normalize_stage(F.col("name")).alias("stage"))
    assert plan_of(found).count("regexp_replace(") == 1
    assert [r.stage for r in found.collect()] == ["generate", "rerank", "retrieve", "tool", "tool"]


def test_a_record_is_parsed_once(spark):
    lines = spark.createDataFrame([(1, '{"trace_id": "t", "ts": "2024-01-01", "spans": [{"stage": "llm"}]}'), (2, "{"), (3, " "), (4, '{"query": "q"}')], "line long, value string")
    good, bad = records.parse_records(lines)
    assert plan_of(good).count("StructField(retrieval_ms") == 1
    assert [(r.trace_id, r.spans[0].stage) for r in good.orderBy("trace_id").collect()] == [("t", "generate"), ("trace-l4", "retrieve")]
    assert [(r.line, r.reason) for r in bad.collect()] == [(2, "not JSON")]


def test_lists_of_an_export_are_cut_out_once(spark):
    exports = spark.createDataFrame([("a", '{"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "0a", "spanId": "0b"}, 7]}, {"spans": 1}, 5]}, {"scopeSpans": {}}, null]}'), ("b", "[[], {}]")], "doc string, value string")
    found = otlp.entries(exports)
    plan = plan_of(found)
    assert all(plan.count(f"$.{key}, ArrayType(VariantType") == 1 or plan.count(f"$.{key}, array<variant>") == 1 for key in ("resourceSpans", "scopeSpans", "spans"))
    rows = sorted((r.level, r.reason or "") for r in found.collect())
    assert rows == sorted([("span", ""), ("span", "not an object"), ("scope", "spans is not a list"), ("scope", "not an object"), ("resource", "scopeSpans is not a list"), ("resource", "not an object"), ("resource", "no resourceSpans list")])
