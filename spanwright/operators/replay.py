"""Session replay: what a trace knew after each span."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_totals(spans: DataFrame, key: str = "trace_id", order: str = "pos") -> DataFrame:
    """``spans`` with step (from 1) and the tokens and cost up to each span, itself included."""
    w = Window.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return spans.select("*", F.row_number().over(w).alias("step"), *(F.sum(c).over(upto).alias(f"{c}_sum") for c in ("tokens_in", "tokens_out", "cost")))


def long_form(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each column of each row: name, value (as text); nulls are absent."""
    each = F.filter(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns)), lambda x: x["value"].isNotNull())
    return df.select(*keys, F.explode(each).alias("x")).select(*keys, "x.name", "x.value")


def state_delta(states: DataFrame, key: str = "trace_id", order: str = "pos") -> DataFrame:
    """Of ``states`` (key, order, name, value), the rows that are new or differ from the value seen last; ties in order go by value."""
    before = F.lag("value").over(Window.partitionBy(key, "name").orderBy(order, "value"))
    return states.withColumn("__before", before).where(F.col("__before").isNull() | (F.col("__before") != F.col("value"))).drop("__before")


def state_at(states: DataFrame, n: int, key: str = "trace_id", order: str = "pos") -> DataFrame:
    """key, name, value: the last value of each name within the first ``n`` positions."""
    return states.where(F.col(order) < n).groupBy(key, "name").agg(F.max_by("value", F.struct(order, "value")).alias("value"))
