"""How well classification and blame find what is known to be there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(found: DataFrame, truth: DataFrame) -> DataFrame:
    """truth, found, n over the traces in either table (trace_id, taxonomy_id); null where one of them has no failure."""
    both = truth.select("trace_id", F.col("taxonomy_id").alias("truth")).join(found.select("trace_id", F.col("taxonomy_id").alias("found")), "trace_id", "full")
    return both.groupBy("truth", "found").agg(F.count("*").alias("n"))


def precision_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall; a failure of another class is both a false one and a missed one."""
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    t, f = F.col("truth"), F.col("found")
    sums = confusion(found, truth).agg(n(t == f).alias("tp"), n(f.isNotNull() & ~t.eqNullSafe(f)).alias("fp"), n(t.isNotNull() & ~t.eqNullSafe(f)).alias("fn"))
    share = lambda other: F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col(other))
    return sums.select("tp", "fp", "fn", share("fp").alias("precision"), share("fn").alias("recall"))


def blame_accuracy(top: DataFrame, truth: DataFrame) -> DataFrame:
    """taxonomy_id, n, accurate (share of the planted failures whose top stage is where the cause is)."""
    found = truth.join(top.select("trace_id", F.col("stage").alias("top")), "trace_id", "left")
    return found.groupBy("taxonomy_id").agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("top") == F.col("stage"), F.lit(False)).cast("double")).alias("accurate"))
