"""Failures of a cohort of traces."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as r
from .order import percentiles

#: Words that speak for a class when an offline scorer reads a description.
KEYWORDS = {
    "F-RET-001": ("empty", "hit_count=0", "no hits", "zero"),
    "F-RET-002": ("low score", "weak context", "hit_scores", "mean_score"),
    "F-PROMPT-001": ("length", "truncat", "prompt_chars", "limit"),
    "F-GEN-001": ("json", "parse", "format", "malformed"),
    "F-GEN-002": ("repeat", "loop", "n-gram"),
    "F-GEN-003": ("refus", "cannot answer", "decline", "abstain"),
    "F-TOOL-001": ("tool", "error", "exception"),
    "F-INFRA-001": ("timeout", "timed out"),
    "F-INFRA-002": ("cost", "spend", "spike"),
    "F-INFRA-003": ("guard", "blocked", "policy", "aborted"),
}


def cost_limit(traces: DataFrame, factor: float = 3.0) -> DataFrame:
    """One row, cost_limit: ``factor`` times the 95th percentile of positive costs; null below 20 of them."""
    paid = traces.where("total_cost > 0")
    limit = paid.agg(F.count("*").alias("n")).join(percentiles(paid, F.col("total_cost"), {"p95": 95.0}), how="left")  # one row each
    return limit.select(F.when(F.col("n") >= 20, F.greatest(F.lit(1e-6), F.col("p95") * factor)).alias("cost_limit"))


#: The rules as one column, by session and limits: to build it takes seconds, however small the table is.
_built: WeakKeyDictionary = WeakKeyDictionary()


def _first_rule(traces: DataFrame, limits: r.Limits, rules: tuple[r.Rule, ...]) -> Column:
    known = _built.setdefault(traces.sparkSession.sparkContext, {})
    if (limits, rules) not in known:
        known[limits, rules] = F.coalesce(*(rule(F.col("spans"), limits) for rule in rules))
    return known[limits, rules]


def verdicts(traces: DataFrame, limits: r.Limits = r.Limits(), limit: DataFrame | None = None, rules: tuple[r.Rule, ...] = r.RULES) -> DataFrame:
    """``traces`` with ``verdict``: that of the first of ``rules`` that fires, or null; a rule is a function from spans and limits to ``rules.verdict``.

    Narrow but for the cohort's cost limit, a single row that is joined to all. ``limit`` takes it from another cohort.
    """
    one = (cost_limit(traces, limits.cost_factor) if limit is None else limit).select(F.col("cost_limit").alias("__cost_limit"))
    rows = traces.crossJoin(F.broadcast(one)).withColumn("__json_error", r.json_error(r.json_candidate(F.col("spans"))))
    return rows.withColumn("verdict", _first_rule(traces, limits, rules)).drop("__cost_limit", "__json_error")


def failures(traces: DataFrame, limits: r.Limits = r.Limits(), include_ambiguous: bool = False, limit: DataFrame | None = None, rules: tuple[r.Rule, ...] = r.RULES) -> DataFrame:
    """trace_id, day, taxonomy_id, stage, confidence, source, evidence of the traces that failed."""
    rows = verdicts(traces, limits, limit, rules)
    if include_ambiguous:
        rows = rows.withColumn("verdict", F.coalesce("verdict", r.fallback(F.col("spans"))))
    return rows.where("verdict is not null").select("trace_id", "day", "verdict.*")


def mix_per_day(failures: DataFrame) -> DataFrame:
    return failures.groupBy("day", "taxonomy_id").agg(F.count("*").alias("n"))


def mix(failures: DataFrame) -> DataFrame:
    """taxonomy_id, n, share."""
    counts = failures.groupBy("taxonomy_id").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # a row for each class


def keyword_verdict(text: Column) -> Column:
    """The class whose keywords occur most often (ties to the smaller id) and its confidence; null without any."""
    from ..functions.text import occurrences

    # the text in small letters and the counts are found once, not wherever they are named
    def best(low: Column) -> Column:
        return F.array_min(F.array(*(F.struct((-sum((occurrences(low, k) for k in words), F.lit(0))).alias("n"), F.lit(c).alias("id")) for c, words in KEYWORDS.items())))

    def told(x: Column) -> Column:
        return F.when(x["n"] < 0, F.struct(x["id"].alias("taxonomy_id"), F.least(F.lit(0.75), 0.40 - 0.05 * x["n"]).alias("confidence")))

    return F.transform(F.transform(F.array(F.lower(text)), best), told)[0]


def keyword_verdicts(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``id_col`` and v, the ``keyword_verdict``, of the rows that have one. Taken from a generator: a filter would score each text anew."""
    return rows.select(id_col, F.explode_outer(F.array(keyword_verdict(text))).alias("v")).where("v is not null")
