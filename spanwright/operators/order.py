"""Exact percentiles whose memory does not grow with the rows.

A sketch of bounded size brackets each percentile: its rank is known within ``1 / ACCURACY`` of the rows. Then only values within the
brackets are counted one by one; all below count as one. So a task holds the different values of a bracket, a few of each
``ACCURACY`` rows, where an exact aggregate holds all different values of a group. Two passes over the rows, in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Inverse of the sketch's error; brackets are ``SLACK`` errors wide on either side.
ACCURACY, SLACK = 20_000, 4


def percentiles(rows: DataFrame, value: Column, names: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """For each group the columns ``names``: percentiles (0 to 100) of ``value`` with linear interpolation; nulls do not count.

    A group without values has no row, and neither has an empty table. ``by`` must have few different values, such as stages:
    a row for each is broadcast.
    """
    plain = rows.select(*by, value.cast("double").alias("__v")).where("__v is not null")
    qs, near = list(names.values()), SLACK / ACCURACY
    around = [min(1.0, max(0.0, q / 100 + side)) for q in qs for side in (-near, near)]
    sketch = plain.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.percentile_approx("__v", around, ACCURACY).alias("__a")).where("__n > 0")
    few = F.col("__n") <= ACCURACY  # where a bracket would be less than some ranks wide, it takes all
    edge = lambda end, k: F.when(few, F.col(end)).otherwise(F.col("__a")[k])
    each = F.array(*(F.struct(F.lit(k).alias("k"), (F.lit(q / 100) * (F.col("__n") - 1)).alias("at"), edge("__min", 2 * k).alias("low"), edge("__max", 2 * k + 1).alias("high")) for k, q in enumerate(qs)))
    wanted = F.broadcast(sketch.select(*by, F.explode(each).alias("__w")))  # a row for each group and percentile
    near_by = (plain.join(wanted, list(by)) if by else plain.crossJoin(wanted)).where(F.col("__v") <= F.col("__w.high"))
    counts = near_by.groupBy(*by, "__w", F.when(F.col("__v") >= F.col("__w.low"), F.col("__v")).alias("__v")).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*by, "__w").orderBy(F.col("__v").asc_nulls_first()))
    placed = counts.select("*", upto.alias("__to"))
    holds = lambda place: F.max(F.when((F.col("__to") - F.col("__c") <= place) & (place < F.col("__to")), F.col("__v")))
    at = F.col("__w.at")
    found = placed.groupBy(*by, "__w").agg(holds(F.floor(at)).alias("__low"), holds(F.ceil(at)).alias("__high"))
    whole = F.when(F.col("__low").isNull() | F.col("__high").isNull(), F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double"))
    between = (F.ceil(at) - at) * F.col("__low") + (at - F.floor(at)) * F.col("__high")
    exact = F.coalesce(whole, F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise(between))
    out = found.groupBy(*by).agg(F.count("*").alias("__n"), *(F.max(F.when(F.col("__w.k") == k, exact)).alias(name) for k, name in enumerate(names)))
    return out.where("__n > 0").drop("__n")
