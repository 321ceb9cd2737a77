"""Session replay: a trace step by step, and what was known after a step.

What a span knows is its attributes that are not null. A step's ``delta`` holds those that are new or differ from the last value; the
state after a step holds the last value of each. Values are JSON. All is a fold over the array of spans, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ATTR_NAMES

_MAP = "map<string,string>"
_STEP = f"array<struct<step:int,span_id:string,name:string,stage:string,status:string,duration_ms:double,delta:{_MAP},tokens_in:bigint,tokens_out:bigint,cost:double>>"


def _json(value: Column) -> Column:
    text = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNotNull(), F.substring(text, F.lit(6), F.length(text) - 6))


def known(span: Column) -> Column:
    """Name and value of the attributes of a span."""
    every = F.map_from_arrays(F.array(*map(F.lit, ATTR_NAMES)), F.array(*(_json(span["attrs"][n]) for n in ATTR_NAMES)))
    return F.map_filter(every, lambda _, v: v.isNotNull())


def _put(state: Column, new: Column) -> Column:
    """``state`` with the entries of ``new``; later ones win."""
    return F.map_concat(F.map_filter(state, lambda k, _: ~F.map_contains_key(new, k)), new)


def _steps(spans: Column) -> Column:
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    start = F.struct(empty.alias("state"), F.lit(0).cast("bigint").alias("tokens_in"), F.lit(0).cast("bigint").alias("tokens_out"), F.lit(0.0).alias("cost"), F.array().cast(_STEP).alias("out"))

    def step(a: Column, x: Column) -> Column:
        own = x["known"]
        sums = {n: (a[n] + F.coalesce(x["span"][n], F.lit(0))).alias(n) for n in ("tokens_in", "tokens_out", "cost")}
        delta = F.map_filter(own, lambda k, v: ~a["state"][k].eqNullSafe(v))
        one = F.struct((F.size(a["out"]) + 1).alias("step"), *(x["span"][n].alias(n) for n in ("span_id", "name", "stage", "status", "duration_ms")), delta.alias("delta"), *sums.values())
        return F.struct(_put(a["state"], own).alias("state"), *sums.values(), F.concat(a["out"], F.array(one)).cast(_STEP).alias("out"))

    return F.aggregate(F.transform(spans, lambda s: F.struct(s.alias("span"), known(s).alias("known"))), start, step, lambda a: a["out"])


def steps(traces: DataFrame) -> DataFrame:
    """trace_id, step (from 1), span_id, name, stage, status, duration_ms, delta, and tokens_in, tokens_out, cost up to the step."""
    return traces.select("trace_id", F.explode(_steps(F.col("spans"))).alias("s")).select("trace_id", "s.*")


def _state(spans: Column, at: int) -> Column:
    seen = F.slice(spans, F.lit(1), F.greatest(F.lit(0), F.least(F.lit(at), F.size(spans))))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    total = lambda n, zero: F.aggregate(seen, zero, lambda a, s: a + F.coalesce(s[n], F.lit(0)))
    return F.struct(
        F.size(seen).alias("step"), F.aggregate(F.transform(seen, known), empty, _put).alias("state"), F.array_sort(F.array_distinct(F.transform(seen, lambda s: s["stage"]))).alias("stages"),
        total("tokens_in", F.lit(0).cast("bigint")).alias("tokens_in"), total("tokens_out", F.lit(0).cast("bigint")).alias("tokens_out"), F.round(total("cost", F.lit(0.0)), 6).alias("cost"),
    )


def state_at(traces: DataFrame, at: int) -> DataFrame:
    """trace_id, step (``at`` within the trace's bounds), state, stages, tokens_in, tokens_out, cost after that step."""
    return traces.select("trace_id", _state(F.col("spans"), at).alias("s")).select("trace_id", "s.*")


def _listed(entries: Column, join: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), join)


def _money(value: Column) -> Column:
    return F.format_string("%.4f", value)


def as_text(traces: DataFrame, at: int | None = None) -> DataFrame:
    """trace_id, text: a line for each step and one for the sums; with ``at`` also the state after that step."""
    line = lambda s: F.format_string("%4d  %-9s %-8s %10.1f ms  %s", s["step"], s["stage"], s["status"], s["duration_ms"], _listed(s["delta"], " "))
    rows = traces.select("trace_id", "pipeline_name", "ts", _steps(F.col("spans")).alias("steps"), *([_state(F.col("spans"), at).alias("at")] if at is not None else []))
    last = F.get(F.col("steps"), F.size("steps") - 1)
    sums = F.when(F.size("steps") > 0, F.concat(F.lit("sums: tokens in "), last["tokens_in"], F.lit(", out "), last["tokens_out"], F.lit(", cost "), _money(last["cost"]))).otherwise("no spans")
    parts = [F.array(F.concat(F.lit("trace "), "trace_id", F.lit(" of "), "pipeline_name", F.lit(" at "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))), F.transform("steps", line), F.array(sums)]
    if at is not None:
        s = F.col("at")
        entries = F.transform(F.array_sort(F.map_entries(s["state"])), lambda e: F.concat(F.lit("  "), e["key"], F.lit(" = "), e["value"]))
        parts += [F.array(F.concat(F.lit("after step "), s["step"], F.lit(": "), F.array_join(s["stages"], ", "))), entries, F.array(F.concat(F.lit("  tokens in "), s["tokens_in"], F.lit(", out "), s["tokens_out"], F.lit(", cost "), _money(s["cost"])))]
    return rows.select("trace_id", F.array_join(F.concat(*parts), "\n").alias("text"))


def as_json(traces: DataFrame, at: int | None = None) -> DataFrame:
    """trace_id, value: the steps, and with ``at`` the state, as one JSON object with its keys in order."""
    entries = lambda m: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"])), ", "), F.lit("}"))
    pairs = lambda **of: F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": '), of[k]) for k in sorted(of))), F.lit("}"))
    number = lambda c: F.coalesce(_json(c), F.lit("null"))
    sums = lambda s: pairs(tokens_in=number(s["tokens_in"]), tokens_out=number(s["tokens_out"]), cost=number(F.round(s["cost"], 6)))
    one = lambda s: pairs(step=number(s["step"]), span_id=number(s["span_id"]), name=number(s["name"]), stage=number(s["stage"]), status=number(s["status"]), duration_ms=number(s["duration_ms"]), delta=entries(s["delta"]), upto=sums(s))
    of = {
        "trace_id": number(F.col("trace_id")), "pipeline_name": number(F.col("pipeline_name")), "ts": number(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        "steps": F.concat(F.lit("["), F.array_join(F.transform(_steps(F.col("spans")), one), ", "), F.lit("]")),
    }
    if at is not None:
        s = _state(F.col("spans"), at)
        of["state"] = pairs(step=number(s["step"]), stages=number(s["stages"]), attrs=entries(s["state"]), upto=sums(s))
    return traces.select("trace_id", pairs(**of).alias("value"))
