"""Blame: which stage of a failed trace is furthest from the healthy baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import mean_of
from ..functions.stats import zscore
from .health import stage_order

#: Signals of each stage, and which direction is bad.
SIGNALS = (
    ("embed", "duration_ms", "high"),
    ("embed", "token_count", "high"),
    ("retrieve", "hit_count", "low"),
    ("retrieve", "mean_hit_score", "low"),
    ("retrieve", "duration_ms", "high"),
    ("rerank", "rerank_delta", "low"),
    ("rerank", "duration_ms", "high"),
    ("graph", "duration_ms", "high"),
    ("generate", "duration_ms", "high"),
    ("generate", "prompt_chars", "high"),
    ("generate", "tokens_in", "high"),
    ("generate", "tokens_out", "both"),
    ("generate", "cost", "high"),
    ("guard", "duration_ms", "high"),
    ("tool", "duration_ms", "high"),
    ("agent", "duration_ms", "high"),
)
EVIDENCE_WEIGHT = 1.5
_ON_SPAN = ("duration_ms", "tokens_in", "tokens_out", "cost")


def measured(traces: DataFrame) -> DataFrame:
    """trace_id, m: what was measured on the spans of each trace, as an array of spec (number of the signal), pos, value.

    Only this is shuffled, never the spans with their texts.
    """

    def of(s: Column) -> Column:
        value = {n: (s[n] if n in _ON_SPAN else s["attrs"][n]).cast("double") for n in dict.fromkeys(x[1] for x in SIGNALS)}
        value["mean_hit_score"] = F.coalesce(value["mean_hit_score"], mean_of(s["attrs"]["hit_scores"]))
        return F.array(*(F.when(s["stage"] == st, F.struct(F.lit(k).alias("spec"), s["pos"].alias("pos"), value[n].alias("value"))) for k, (st, n, _) in enumerate(SIGNALS)))

    own = F.filter(F.flatten(F.transform("spans", of)), lambda x: x["value"].isNotNull())
    return traces.select("trace_id", own.alias("m"))


def _of_spec(k: int, spec: Column) -> Column:
    """Stage, signal or direction (``k``) of a signal's number."""
    return F.array(*(F.lit(x[k]) for x in SIGNALS))[spec]


def baseline(traces: DataFrame, failures: DataFrame) -> DataFrame:
    """stage, signal, mean, std over the traces that did not fail; signals that are always 0 have none."""
    healthy = measured(traces).join(failures.select("trace_id").distinct(), "trace_id", "left_anti").select(F.explode_outer("m").alias("x")).where("x is not null")  # a plain explode would have its array built twice, for a filter
    out = healthy.groupBy("x.spec").agg(F.avg("x.value").alias("mean"), F.stddev_pop("x.value").alias("std"))
    return out.where("mean <> 0 or std <> 0").select(_of_spec(0, F.col("spec")).alias("stage"), _of_spec(1, F.col("spec")).alias("signal"), "mean", "std")


def last_failure(failures: DataFrame) -> DataFrame:
    """trace_id, taxonomy_id, stage: of several failures of a trace the last one, by ``seq`` if there is such a column, else by class and stage."""
    order = F.struct(*(["seq"] if "seq" in failures.columns else []), "taxonomy_id", "stage")
    return failures.groupBy("trace_id").agg(F.max_by(F.struct("taxonomy_id", "stage"), order).alias("f")).select("trace_id", "f.*")


def candidates(traces: DataFrame, failures: DataFrame, base: DataFrame) -> DataFrame:
    """trace_id, stage, signal, z_score, score, rank of the suspicious stages of each failed trace."""
    last = last_failure(failures).withColumnRenamed("stage", "pinned")
    # a trace is one row from here on, and its stages are compared within it
    rows = measured(traces).join(last, "trace_id").groupBy("trace_id", "taxonomy_id", "pinned").agg(F.flatten(F.collect_list("m")).alias("m"))
    number = F.create_map(*(F.lit(x) for k, (st, n, _) in enumerate(SIGNALS) for x in (f"{st}/{n}", k)))[F.concat_ws("/", "stage", "signal")]
    known = base.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(number, F.struct("mean", "std")))).alias("b"))  # one row, an entry for each signal
    rows = rows.crossJoin(F.broadcast(known.select(F.array(*(F.try_element_at("b", F.lit(k)) for k in range(len(SIGNALS)))).alias("__base"))))

    def scored(x: Column) -> Column:
        of = F.get(F.col("__base"), x["spec"])
        return F.transform(F.array(zscore(x["value"], of["mean"], of["std"])), lambda z: F.transform(F.array(F.when(_of_spec(2, x["spec"]) == "high", z).when(_of_spec(2, x["spec"]) == "low", -z).otherwise(F.abs(z))), lambda b: F.struct(_of_spec(0, x["spec"]).alias("stage"), F.round(b, 9).alias("z9"), (-x["pos"]).alias("before"), (-x["spec"]).alias("spec"), b.alias("z"))))

    found = F.filter(F.flatten(F.flatten(F.transform("m", scored))), lambda x: x["z"] > 0)
    ordered = F.sort_array(found, asc=False)  # by stage; the worst of each first
    best = F.transform(F.array(ordered), lambda o: F.filter(o, lambda x, i: (i == 0) | (F.get(o, i - 1)["stage"] != x["stage"])))[0]
    score = lambda x: F.round(x["z"] + F.when(x["stage"] == F.col("pinned"), EVIDENCE_WEIGHT).otherwise(0.0), 4)
    ranked = F.sort_array(F.transform(best, lambda x: F.struct(score(x).alias("score"), (-stage_order(x["stage"])).alias("order"), x["stage"].alias("stage"), _of_spec(1, -x["spec"]).alias("signal"), F.round(x["z"], 4).alias("z_score"))), asc=False)
    out = rows.select("trace_id", "taxonomy_id", F.posexplode_outer(ranked).alias("i", "x")).where("x is not null")
    return out.select("trace_id", "taxonomy_id", "x.stage", "x.signal", "x.z_score", "x.score", (F.col("i") + 1).alias("rank"))


def top_stage(traces: DataFrame, failures: DataFrame, base: DataFrame) -> DataFrame:
    """trace_id, taxonomy_id, stage: the most suspicious stage, or the classifier's where none is suspicious."""
    top = candidates(traces, failures, base).where("rank = 1").select("trace_id", F.col("stage").alias("top"))
    return last_failure(failures).join(top, "trace_id", "left").select("trace_id", "taxonomy_id", F.coalesce("top", "stage").alias("stage"))


def cohort_shares(top: DataFrame) -> DataFrame:
    """taxonomy_id, stage, n, share: how the blame for each class is spread."""
    counts = top.groupBy("taxonomy_id", "stage").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("taxonomy_id")))


def weighted_shares(top: DataFrame) -> DataFrame:
    """stage, share of all blame."""
    counts = top.groupBy("stage").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # a row for each stage
