"""Telemetry exports in OTLP/JSON as spans and traces.

An export is a JSON document: one request, or a list of requests. Three levels (resources, scopes, spans) are
exploded as variants; an entry of the wrong shape is one row with a ``reason`` and nothing below it is read. A document that is
not JSON fails the job. Attributes nest without limit, so a small Arrow function flattens them; all else are columns.

Defined results: an empty table gives empty tables; a null document is no export; a span that repeats is kept twice.
"""

from __future__ import annotations

import base64
import binascii
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.stages import hex_id, infer_stage, is_root, span_status
from ..schema import ATTRS, SPAN

#: Keys that carry a measure, the first one present decides.
TOKENS_IN = ("gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens", "llm.token_count.prompt", "usage.input_tokens", "prompt_tokens")
TOKENS_OUT = ("gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens", "llm.token_count.completion", "usage.output_tokens", "completion_tokens")
COST = ("gen_ai.usage.cost", "llm.cost.total", "openinference.span.cost", "cost")
MODEL = ("gen_ai.request.model", "gen_ai.response.model", "llm.model_name", "model_name", "model")
FINISH = ("gen_ai.response.finish_reasons", "finish_reason", "response.finish_reason")
OUTPUT = ("gen_ai.completion", "output.value", "output_value", "llm.output_messages", "output", "completion")
PROMPT = ("gen_ai.prompt", "input.value", "input_value", "prompt", "llm.input_messages")
QUERY = ("retrieval.query", "search.query", "query", "input.value")
TOP_K = ("retrieval.top_k", "top_k", "topk")
DOCUMENTS = ("retrieval.documents", "retrieval_documents")

#: Skipped entries whose reasons a report lists.
LISTED = 200


def _plain(value: Any) -> Any:
    """A typed value as a plain one."""
    if not isinstance(value, dict):
        return value
    for kind in ("stringValue", "boolValue", "doubleValue"):
        if kind in value:
            return value[kind]
    if "intValue" in value:
        try:
            return int(value["intValue"])
        except (TypeError, ValueError):
            return value["intValue"]
    if "bytesValue" in value:
        try:
            return base64.b64decode(value["bytesValue"]).hex()
        except (binascii.Error, ValueError, TypeError):
            return value["bytesValue"]
    for kind, read in (("arrayValue", lambda x: [_plain(v) for v in x]), ("kvlistValue", _named)):
        if kind in value:
            return read((value[kind] or {}).get("values") or [])
    return value


def _named(raw: Any) -> dict[str, Any]:
    """Attributes from a list of keys and values (the last of equal keys counts) or from an object."""
    pairs = raw.items() if isinstance(raw, dict) else [(x["key"], x.get("value")) for x in raw if isinstance(x, dict) and "key" in x] if isinstance(raw, list) else []
    return {str(k): _plain(v) for k, v in pairs}


@F.pandas_udf(StringType())
def flat_attributes(raw: pd.Series) -> pd.Series:
    """Attributes in JSON as a flat JSON object."""
    return raw.map(lambda x: json.dumps(_named(json.loads(x)) if x else {}))


def whole_number(raw: Column) -> Column:
    """An integer written as digits, also within blanks; null for all else."""
    return F.when(F.trim(raw).rlike(r"^[+-]?\d+$"), F.trim(raw).try_cast("bigint"))


def nanos_to_time(ns: Column) -> Column:
    """Nanoseconds since 1970 as a timestamp, without passing through a float."""
    return F.timestamp_micros(F.floor(ns / F.lit(1000).cast("decimal(4,0)")).cast("long"))


def first_present(attrs: Column, keys: tuple[str, ...], prefix: str | None = None) -> Column:
    """Value of the first of ``keys`` that ``attrs`` has, even if it is null; without any of them that of the first key that begins with ``prefix``."""
    out = F.lit(None).cast("string")
    if prefix is not None:
        like = F.get(F.filter(F.map_keys(attrs), lambda k: k.startswith(prefix)), F.lit(0))
        out = F.when(like.isNotNull(), attrs[like])
    for key in reversed(keys):
        out = F.when(F.map_contains_key(attrs, key), attrs[key]).otherwise(out)
    return out


def _items(text: Column) -> Column:
    """Elements of a JSON array as texts; null for anything else."""
    return F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, "array<string>"))


def _is_object(text: Column) -> Column:
    return F.startswith(F.ltrim(text), F.lit("{"))


def message_text(raw: Column) -> Column:
    """A text as it is; of a list of messages their contents, one a line."""
    part = lambda m: F.when(_is_object(m), F.coalesce(F.get_json_object(m, "$.content"), F.get_json_object(m, "$.text"), F.lit(""))).otherwise(m)
    return F.nullif(F.coalesce(F.array_join(F.transform(_items(raw), part), "\n"), raw), F.lit(""))


def canonical(attrs: Column) -> dict[str, Column]:
    """Measures of a span by the names of the trace model, from its attributes (a map of texts)."""
    docs = F.try_variant_get(F.try_parse_json(first_present(attrs, DOCUMENTS)), "$", "array<variant>")
    # a key that is there counts, whatever its value; only numbers are scores
    of = lambda d, name: F.coalesce(F.try_variant_get(d, f"$['document.{name}']", "variant"), F.try_variant_get(d, f"$.{name}", "variant"))
    number = lambda v: F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, "$", "double"))
    scores = F.filter(F.transform(docs, lambda d: F.when(_object(d).isNotNull(), number(of(d, "score"))).otherwise(number(d))), lambda x: x.isNotNull())
    contents = F.filter(F.transform(docs, lambda d: F.when(_object(d).isNotNull(), F.try_variant_get(of(d, "content"), "$", "string"))), lambda x: x.isNotNull() & (x != ""))
    finish, query = first_present(attrs, FINISH), first_present(attrs, QUERY, prefix="retrieval.query")
    return {
        "tokens_in": F.coalesce(whole_number(first_present(attrs, TOKENS_IN)), F.lit(0)), "tokens_out": F.coalesce(whole_number(first_present(attrs, TOKENS_OUT)), F.lit(0)),
        "cost": F.coalesce(first_present(attrs, COST).try_cast("double"), F.lit(0.0)), "model": first_present(attrs, MODEL),
        "finish_reason": F.coalesce(F.get(_items(finish), F.lit(0)), finish), "output": message_text(first_present(attrs, OUTPUT)),
        "prompt_chars": F.length(message_text(first_present(attrs, PROMPT))), "query": F.when(~_is_object(query) & _items(query).isNull(), query),
        "top_k": whole_number(first_present(attrs, TOP_K)).cast("int"),
        "hit_count": F.coalesce(F.nullif(F.size(docs), F.lit(0)), whole_number(attrs["match.count"]).cast("int"), attrs["hit_count"].try_cast("int")),
        "hit_scores": F.when(F.size(scores) > 0, scores), "context": F.nullif(F.array_join(contents, "\n"), F.lit("")),
    }


def _exploded(rows: DataFrame, items: Column, at: str, item: str) -> DataFrame:
    return rows.select("*", F.posexplode(items).alias(at, item))


def _object(v: Column) -> Column:
    """Not null for an object. Nothing of it is copied."""
    return F.try_variant_get(v, "$", "struct<__none:variant>")


def _list(v: Column, key: str) -> Column:
    """The array under ``key``: empty where it is missing or null, null where it is something else."""
    own = F.try_variant_get(v, f"$.{key}", "variant")
    return F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.when(own.isNull() | F.is_variant_null(own), F.array().cast("array<variant>")))


def entries(exports: DataFrame, value: str = "value", order: str = "doc") -> DataFrame:
    """level, reason, place and, where reason is null, the span's variant with its service, resource and scope, of each entry in ``exports`` (``order``, ``value``).

    One pass over each export: what cannot be opened is carried on as a single row with its reason.
    """
    text = F.col(value)
    rows = exports.where(text.isNotNull()).select(F.col(order).cast("string").alias("doc"), F.coalesce(F.try_parse_json(text), F.raise_error(F.lit("an export is not JSON"))).alias("v"))
    rows = _exploded(rows, F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v")), "i", "request").drop("v")
    rows = rows.select("*", F.lit(None).cast("string").alias("reason"), F.lit("span").alias("level"), F.array("i").alias("place"))
    none = F.array(F.lit(None).cast("variant"))

    def opened(rows: DataFrame, level: str, of: str, bad: str, key: str, at: str, item: str) -> DataFrame:
        """A row for each of ``__items``, the list under ``key`` of ``of``, which is cut out once; of a bad one, or of what was bad already, one row."""
        rows = rows.withColumn("__items", F.when(F.col("reason").isNull() & _object(F.col(of)).isNotNull(), _list(F.col(of), key)))
        no_object = F.when(_object(F.col(of)).isNull(), "not an object" if of != "request" else bad)
        rows = rows.withColumn("__bad", F.when(F.col("reason").isNull() & F.col("__items").isNull(), F.coalesce(no_object, F.lit(bad))))
        rows = rows.withColumns({"level": F.when(F.col("__bad").isNotNull(), F.lit(level)).otherwise(F.col("level")), "reason": F.coalesce("reason", "__bad")})
        rows = _exploded(rows, F.when(F.col("reason").isNotNull(), none).otherwise(F.col("__items")), at, item).drop("__bad", "__items")
        return rows.withColumn("place", F.when(F.col("reason").isNull(), F.concat("place", F.array(at))).otherwise(F.col("place")))

    rows = opened(rows, "resource", "request", "no resourceSpans list", "resourceSpans", "r", "entry").drop("request")
    rows = opened(rows.withColumn("resource", F.when(F.col("reason").isNull(), flat_attributes(F.to_json(F.try_variant_get("entry", "$.resource.attributes", "variant"))))), "resource", "entry", "scopeSpans is not a list", "scopeSpans", "s", "part").drop("entry")
    rows = opened(rows.withColumn("scope", F.try_variant_get("part", "$.scope.name", "string")), "scope", "part", "spans is not a list", "spans", "k", "span").drop("part")
    one = lambda key: F.try_variant_get("span", f"$.{key}", "string")
    bad = F.when(_object(F.col("span")).isNull(), "not an object").when(hex_id(one("traceId")).isNull(), "missing or unreadable traceId").when(hex_id(one("spanId")).isNull(), "missing or unreadable spanId")
    service = F.coalesce(F.get_json_object("resource", "$['service.name']"), F.lit("unknown"))
    reason = F.coalesce("reason", bad)
    return rows.select("level", reason.alias("reason"), "doc", "place", "span", *(F.when(reason.isNull() | (F.col("level") == "span"), x).alias(n) for n, x in (("service", service), ("resource", F.col("resource")), ("scope", F.col("scope")))))


def skips(entries: DataFrame) -> DataFrame:
    """level, skipped, reasons: how many entries were dropped, exactly, and the first ``LISTED`` reasons of each level."""
    rows = entries.where("reason is not null")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("level").orderBy("doc", "place"))).where(f"n <= {LISTED}")
    reasons = first.groupBy("level").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "reason"))), lambda x: x["reason"]).alias("reasons"))
    return rows.groupBy("level").agg(F.count("*").alias("skipped")).join(reasons, "level")


def spans(entries: DataFrame, with_skipped: bool = False) -> DataFrame:
    """One row for each span that can be read: doc, place, trace_id, start_ns, service, scope, resource and the columns of the trace model's spans but pos.

    ``with_skipped`` keeps the entries that cannot be read, with level and reason, and those two columns.
    """
    one = lambda key: F.try_variant_get("span", f"$.{key}", "string")
    rows = entries if with_skipped else entries.where("level = 'span' and reason is null")
    rows = rows.withColumn("flat", flat_attributes(F.to_json(F.try_variant_get("span", "$.attributes", "variant"))))
    rows = rows.withColumn("attrs", F.from_json("flat", "map<string,string>")).withColumn("name", F.coalesce(F.nullif(one("name"), F.lit("")), F.lit("span")))
    start, end, spent = (whole_number(one(k)) for k in ("startTimeUnixNano", "endTimeUnixNano", "durationNanos"))
    ns = F.when(end >= start, end - start).otherwise(spent)
    status = span_status(one("status.code"), F.col("name"))
    error = F.when(span_status(one("status.code"), F.lit("")) == "error", F.nullif(one("status.message"), F.lit("")))
    known = canonical(F.col("attrs"))
    parent = F.when(~is_root(hex_id(one("parentSpanId"))), hex_id(one("parentSpanId")))
    of = {n: F.coalesce(known[n], F.lit(None)) if n in known else F.col("attrs")[n].try_cast(t) for n, t in (x.split(" ") for x in ATTRS.split(", "))}
    attrs = F.struct(*(v.alias(n) for n, v in (of | {"error": F.coalesce(error, F.col("attrs")["error"])}).items())).cast(f"struct<{ATTRS}>")
    return rows.select(
        *(["level", "reason"] if with_skipped else []), "doc", "place", hex_id(one("traceId")).alias("trace_id"), start.alias("start_ns"), "service", "scope", F.from_json("resource", "map<string,string>").alias("resource"),
        hex_id(one("spanId")).alias("span_id"), parent.alias("parent_id"), "name", infer_stage(F.col("name"), F.col("attrs")).alias("stage"), F.round(F.coalesce(ns, F.lit(0)) / 1e6, 3).alias("duration_ms"),
        status.alias("status"), *(known[n].alias(n) for n in ("tokens_in", "tokens_out", "cost")), attrs.alias("attrs"),
    )


def traces(spans: DataFrame) -> DataFrame:
    """Spans as traces of the model, with meta (scopes and resource attributes).

    Spans are in the order of their starts where all are known, else as they were written; the time is that of the first start, or 1970.
    """
    order = F.struct("doc", "place")
    columns = [x.split(" ")[0] for x in SPAN.split(", attrs ")[0].split(", ") if not x.startswith("pos ")] + ["attrs"]
    start = F.when(F.bool_and(F.col("start_ns").isNotNull()).over(Window.partitionBy("trace_id")), F.col("start_ns"))
    rows = spans.withColumn("__start", start).groupBy("trace_id").agg(
        F.array_sort(F.collect_list(F.struct("__start", "doc", "place", *columns)), lambda a, b: _before(a, b)).alias("s"), F.min("start_ns").alias("first"), F.min_by("service", order).alias("pipeline_name"),
        F.array_sort(F.collect_set(F.nullif("scope", F.lit("")))).alias("scopes"), F.sort_array(F.collect_list(F.struct("doc", "place", F.map_entries("resource").alias("resource")))).alias("resources"),
    )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def put(all_: Column, one: Column) -> Column:
        new = F.map_filter(F.map_from_entries(one["resource"]), lambda k, v: k != "service.name")
        return F.map_concat(F.map_filter(all_, lambda k, v: ~F.map_contains_key(new, k)), new)

    span = F.transform("s", lambda x, i: F.struct(i.alias("pos"), *(x[c].alias(c) for c in columns))).cast(f"array<struct<{SPAN}>>")
    ts = F.coalesce(nanos_to_time(F.col("first")), F.timestamp_micros(F.lit(0)))
    meta = F.struct("scopes", F.aggregate("resources", empty, put).alias("resource"))
    return rows.select("trace_id", ts.alias("ts"), F.to_date(ts).alias("day"), "pipeline_name", F.aggregate("s", F.lit(0.0), lambda a, x: a + x["cost"]).alias("total_cost"), span.alias("spans"), meta.alias("meta"))


def _before(a: Column, b: Column) -> Column:
    """Order of two spans: by start, if known, then as written."""
    key = lambda x: F.struct(x["__start"], x["doc"], x["place"])
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def parse(exports: DataFrame, value: str = "value", order: str = "doc") -> DataFrame:
    """The traces of all exports."""
    return traces(spans(entries(exports, value, order)))
