"""Pass 2: traces on which no rule fired although something is off go to a model, or to a keyword scorer.

Only these traces are asked about. A model is a function from prompt to reply, made once in each Python worker by a
factory, so that clients and their connections are never pickled. A reply that fails or cannot be read gives the
verdict of the signals alone (``rules.fallback``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as r
from ..schema import TAXONOMY
from .classify import keyword_verdict

#: From a prompt to a reply; and what makes it.
Model = Callable[[str], str]
ModelFactory = Callable[[], Model]

#: Attributes that a summary tells, and items of it that a verdict keeps as evidence.
TOLD, KEPT = ("hit_count", "mean_hit_score", "finish_reason", "output", "blocked"), 4


def summary(spans: Column) -> Column:
    """Evidence on all spans in order: their status and the attributes ``TOLD``, of 100 characters at most."""

    def of(s: Column) -> Column:
        told = F.array(*(F.when(s["attrs"][k].isNotNull(), r.evidence(s, k, F.left(s["attrs"][k].cast("string"), F.lit(100)))) for k in TOLD))
        return F.concat(F.array(r.evidence(s, "status", s["status"])), F.filter(told, lambda e: e.isNotNull()))

    return F.flatten(F.transform(spans, of))


def ask(traces: DataFrame) -> DataFrame:
    """``traces`` that have ambiguity signals and no ``verdict`` (a column of ``classify.verdicts``), with signals, summary, prompt."""
    rows = traces.where("verdict is null").withColumn("signals", r.ambiguity(F.col("spans"))).where(F.size("signals") > 0).withColumn("summary", summary(F.col("spans")))
    told = F.array_join(F.transform("summary", lambda e: F.concat(F.coalesce(e["span_id"], F.lit("-")), F.lit(":"), e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "; ")
    offered = "\n".join(f"- {c}: {name}" for c, (name, _) in TAXONOMY.items())
    rest = f"\nChoose one class:\n{offered}\nReply with two lines:\nTAXONOMY: <class>\nCONFIDENCE: <0..1>"
    return rows.withColumn("prompt", F.concat(F.lit("A request went wrong and no rule names how. Signals: "), F.array_join("signals", ", "), F.lit("\nSpans: "), told, F.lit(rest)))


def read_reply(reply: Column) -> Column:
    """taxonomy_id: the first class that a reply names; confidence: the number after CONFIDENCE, if it lies in 0 to 1.

    Null for a null reply, one without a class, or one whose confidence is no number.
    """
    named, number = (F.nullif(F.regexp_extract(reply, p, k), F.lit("")) for p, k in ((r"F-[A-Z]+-\d{3}", 0), (r"CONFIDENCE:\s*([0-9.]+)", 1)))
    value = number.try_cast("double")
    sound = named.isNotNull() & (number.isNull() | value.isNotNull())
    return F.when(sound, F.struct(named.alias("taxonomy_id"), F.when(value.between(0.0, 1.0), value).alias("confidence")))


def replies(asked: DataFrame, factory: ModelFactory) -> DataFrame:
    """``asked`` with ``reply``: the model's, null where it raised."""
    schema = asked.select("*", F.lit(None).cast("string").alias("reply")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            got = []
            for prompt in batch["prompt"]:
                try:
                    got.append(model(prompt))
                except Exception:  # an unreachable model must not fail the job: the signals decide
                    got.append(None)
            yield batch.assign(reply=pd.Series(got, index=batch.index, dtype=object))

    return asked.mapInPandas(run, schema)


def second_pass(verdicts: DataFrame, factory: ModelFactory | None = None, offline: bool = False) -> DataFrame:
    """trace_id, day, taxonomy_id, stage, confidence, source, evidence of the ambiguous traces of ``classify.verdicts``.

    ``factory`` makes the model; ``offline`` scores keywords in the summary instead; with neither, the signals decide.
    """
    asked = ask(verdicts).select("trace_id", "day", "signals", "summary", "prompt", r.fallback(F.col("spans")).alias("otherwise"))
    if factory is not None:
        given = replies(asked.select("trace_id", "prompt"), factory)
        rows = asked.drop("prompt").join(given.select("trace_id", read_reply(F.col("reply")).alias("read")), "trace_id")
    elif offline:
        told = F.array_join(F.transform("summary", lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "; ")
        rows = asked.withColumn("read", keyword_verdict(F.concat(F.array_join("signals", ", "), F.lit("; "), told)))
    else:
        rows = asked.withColumn("read", F.lit(None).cast("struct<taxonomy_id:string,confidence:double>"))
    stages = F.create_map(*(F.lit(x) for c, (_, s) in TAXONOMY.items() for x in (c, s)))
    stage = F.coalesce(F.try_element_at(stages, F.col("read.taxonomy_id")), F.lit("generate"))
    kept = F.slice("summary", 1, KEPT)
    told = F.struct(F.col("read.taxonomy_id").alias("taxonomy_id"), stage.alias("stage"), F.coalesce("read.confidence", F.lit(0.5)).alias("confidence"), F.lit("llm").alias("source"), kept.alias("evidence"))
    found = F.when(F.col("read.taxonomy_id").isNotNull(), told).otherwise(F.col("otherwise").withField("evidence", kept))
    # from a generator: a filter on it would be moved below and judge each trace anew
    return rows.select("trace_id", "day", F.explode_outer(F.array(found)).alias("v")).where("v is not null").select("trace_id", "day", "v.*")
