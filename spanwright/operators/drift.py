"""Drift of the failure mix: chi-square over trailing windows, and CUSUM for each class.

All inputs are counts by day and class, so that every table here has at most days x classes rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chi2_sf
from ..keeping import keep


def daily_grid(daily: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """day, day_idx (from 1, over the days that occur), taxonomy_id, n (0 where a class has none).

    ``days`` (day) adds those on which nothing failed: the days of all traces, say.
    """
    every = daily.select("day") if days is None else daily.select("day").union(days.select("day"))
    days = every.distinct().withColumn("day_idx", F.row_number().over(Window.orderBy("day")))  # a row for each day
    grid = days.crossJoin(daily.select("taxonomy_id").distinct())  # days x classes
    return grid.join(daily, ["day", "taxonomy_id"], "left").select("day", "day_idx", "taxonomy_id", F.coalesce("n", F.lit(0)).alias("n"))


def on_days(rows: DataFrame, days: DataFrame) -> DataFrame:
    """The rows of those days that ``days`` names; a null day is on none."""
    return rows.join(F.broadcast(days.select("day").distinct()), "day", "left_semi")  # a row for each day


def baseline_mix(grid: DataFrame, baseline_days: int = 14) -> DataFrame:
    """taxonomy_id, share in the first days."""
    base = grid.where(F.col("day_idx") <= baseline_days).groupBy("taxonomy_id").agg(F.sum("n").alias("n"))
    return base.select("taxonomy_id", (F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy(F.lit(0))), F.lit(0))).alias("share"))  # a row for each class


def trailing(grid: DataFrame, baseline_days: int = 14, window_days: int = 3) -> DataFrame:
    """day, day_idx, taxonomy_id, observed: counts over windows that lie after the baseline."""
    w = Window.partitionBy("taxonomy_id").orderBy("day_idx").rowsBetween(1 - window_days, 0)
    return grid.withColumn("observed", F.sum("n").over(w)).where(F.col("day_idx") >= baseline_days + window_days).drop("n")


def chi_square(grid: DataFrame, baseline_days: int = 14, window_days: int = 3, two_cell: bool = False) -> DataFrame:
    """day, day_idx, chi2, df of each window against the baseline's mix.

    Classes with an expected count below 5 are one cell, unless fewer than two others are left. ``two_cell``
    also pools all others into one.
    """
    rows = trailing(grid, baseline_days, window_days).join(baseline_mix(grid, baseline_days), "taxonomy_id")
    every = Window.partitionBy("day_idx")
    rows = rows.withColumn("expected", F.col("share") * F.sum("observed").over(every))
    rows = rows.withColumn("large", F.sum(F.when(F.col("expected") >= 5, 1).otherwise(0)).over(every))
    own = F.lit("all") if two_cell else F.col("taxonomy_id")
    cell = F.when((F.col("expected") < 5) & (F.col("large") >= 2), "other").otherwise(own)
    cells = rows.groupBy("day", "day_idx", cell.alias("cell")).agg(F.sum("observed").alias("o"), F.sum("expected").alias("e")).where("e > 0")
    return cells.groupBy("day", "day_idx").agg(F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")).alias("chi2"), (F.count("*") - 1).alias("df"))


def two_of_three(flags: DataFrame, lookback: int = 3, least: int = 2) -> DataFrame:
    """day_idx, sig -> day_idx, sig, alert: set flags with ``least`` set ones among the last ``lookback`` since the last alert."""
    series = flags.groupBy().agg(F.array_sort(F.collect_list(F.struct("day_idx", "sig"))).alias("x"))  # a row for each day
    start = F.struct(F.array().cast("array<boolean>").alias("recent"), F.array().cast("array<struct<day_idx:int,sig:boolean,alert:boolean>>").alias("out"))

    def step(a, x):
        recent = F.concat(F.when(F.size(a["recent"]) >= lookback, F.slice(a["recent"], 2, lookback)).otherwise(a["recent"]), F.array(x["sig"]))
        alert = x["sig"] & (F.size(F.filter(recent, lambda r: r)) >= least)
        return F.struct(F.when(alert, F.array().cast("array<boolean>")).otherwise(recent).alias("recent"), F.concat(a["out"], F.array(F.struct(x["day_idx"].cast("int").alias("day_idx"), x["sig"].alias("sig"), alert.alias("alert")))).alias("out"))

    return series.select(F.explode(F.aggregate("x", start, step, lambda a: a["out"])).alias("r")).select("r.*")


def cusum(grid: DataFrame, baseline_days: int = 14, k: float = 0.5, h: float = 5.0) -> DataFrame:
    """day_idx, taxonomy_id, cusum, alert for each day after the baseline; an alert resets the sum."""
    base = grid.where(F.col("day_idx") <= baseline_days).groupBy("taxonomy_id").agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std")).where("mean > 0 and std > 1e-9")
    series = grid.where(F.col("day_idx") > baseline_days).groupBy("taxonomy_id").agg(F.array_sort(F.collect_list(F.struct("day_idx", "n"))).alias("x")).join(base, "taxonomy_id")
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<struct<day_idx:int,cusum:double,alert:boolean>>").alias("out"))

    def step(a, x):
        s = F.greatest(F.lit(0.0), a["s"] + (x["n"] - F.col("mean")) / F.col("std") - k)
        return F.struct(F.when(s > h, 0.0).otherwise(s).alias("s"), F.concat(a["out"], F.array(F.struct(x["day_idx"].cast("int").alias("day_idx"), s.alias("cusum"), (s > h).alias("alert")))).alias("out"))

    return series.select("taxonomy_id", F.explode(F.aggregate("x", start, step, lambda a: a["out"])).alias("r")).select("taxonomy_id", "r.*")


def alerts(daily: DataFrame, baseline_days: int = 14, window_days: int = 3, alpha: float = 0.01, two_cell: bool = False, h: float = 5.0, days: DataFrame | None = None) -> DataFrame:
    """type, day, taxonomy_id, statistic of each alert; ``days`` as for ``daily_grid``."""
    grid = daily_grid(keep(daily, "daily"), days)  # days x classes rows; not kept, every branch below would count the failures anew
    tested = chi_square(grid, baseline_days, window_days, two_cell).withColumn("p", chi2_sf("chi2", F.col("df").cast("double")))
    fired = two_of_three(tested.select("day_idx", F.coalesce(F.col("p") < alpha, F.lit(False)).alias("sig"))).where("alert").select("day_idx")
    chi = tested.join(fired, "day_idx").select(F.lit("chi_square").alias("type"), "day", F.lit(None).cast("string").alias("taxonomy_id"), F.col("chi2").alias("statistic"))
    days = grid.select("day", "day_idx").distinct()
    sums = cusum(grid, baseline_days, h=h).where("alert").join(days, "day_idx").select(F.lit("cusum").alias("type"), "day", "taxonomy_id", F.col("cusum").alias("statistic"))
    return chi.unionByName(sums)
