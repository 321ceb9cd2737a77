"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 64-bit hash of its id and text. For one source and budget the
documents with a hash below a threshold are taken; a threshold is found from
sums of sizes by source and hash bucket, refining only the bucket in which a
budget falls. No sort of the documents takes place. Because thresholds of
growing budgets grow, mixes of several budgets are nested.

A target above a source's size takes every document once (or more) and a
hash-selected part once more.

Defined results: a null text has size 0; sizes of 0 take 0; a null source is a
source of its own, after all others; rows that repeat id and text share a hash
and are taken or left together; an empty table gives an empty table; other columns
are kept by ``repeat`` and ignored by ``sizes``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, materialise

#: Bits of the hash that one histogram resolves.
BITS = 12


def sizes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size (words) and hash of each document."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), F.col(text)).alias("hash"),
    )


def targets(sized: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """source, source_size, target: ``share`` of all sizes, split by weight, none above ``limit`` times its size.

    Handing the excess of full sources to the others by weight ends where each
    source has min(limit * size, level * weight) for one common level; the level
    follows from running sums over the sources in the order of limit * size / weight.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("__k") % len(weights) + 1).cast("int"))
    per = per.withColumn("__k", position).withColumn("__w", weight).withColumn("__cap", limit * F.col("source_size"))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "__k").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("__full", F.coalesce(F.sum("__cap").over(order), F.lit(0.0)))
    per = per.withColumn("__open", F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(order), F.lit(0.0)))
    level = (share * F.sum("source_size").over(every) - F.col("__full")) / F.col("__open")
    per = per.withColumn("__level", level)
    # the first source, in this order, that stays below its cap fixes the level
    level = F.min(F.when(F.col("__level") <= F.col("__cap") / F.col("__w"), F.struct(F.col("__cap") / F.col("__w"), "__k", "__level"))).over(every)["__level"]
    target = F.coalesce(F.least(F.col("__cap"), level * F.col("__w")), F.col("__cap")).cast("double")
    return per.select("source", "source_size", target.alias("target"))


def key(source: str = "source") -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """key, budget_id, threshold, inclusive: taking the hashes below the threshold, and it too if inclusive, comes nearest to the budget.

    ``budgets``: key, budget_id, budget. Each level sums the sizes by key and by
    the next ``BITS`` bits of the hash, but only inside the bucket in which the
    level before crossed a budget; it ends where those buckets hold one hash each.
    Both tables that it joins with have a row for each source and budget.
    """
    data = sized.where(F.col("size") > 0).select(key().alias("key"), "size", "hash")
    state = budgets.select("key", "budget_id", F.col("budget").cast("double").alias("rest"), F.lit(None).cast("long").alias("bucket"))
    before = None
    for low in (*range(64 - BITS, 0, -BITS), 0):
        inside = data.withColumn("bucket", F.shiftright("hash", low))
        if before:
            inside = inside.withColumn("parent", F.shiftright("hash", before)).join(state.select("key", F.col("bucket").alias("parent")).distinct(), ["key", "parent"], "left_semi")
        else:
            inside = inside.withColumn("parent", F.lit(None).cast("long"))
        before = low
        sums = inside.groupBy("key", "parent", "bucket").agg(F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        budget = state.select(F.col("key").alias("k"), "budget_id", "rest", F.col("bucket").alias("p"))
        each = sums.join(budget, (F.col("key") == F.col("k")) & F.col("parent").eqNullSafe(F.col("p")))
        running = Window.partitionBy("key", "budget_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        each = each.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
        crossed = each.where(F.col("before") < F.col("rest")).groupBy("key", "budget_id").agg(
            F.max_by(F.struct((F.col("rest") - F.col("before")).alias("rest"), "bucket", "size", "low", "high"), "bucket").alias("x")
        )
        state = materialise(crossed.select("key", "budget_id", "x.*"), "mix-state")
        if not state.where(F.col("low") < F.col("high")).head(1):
            break
    return state.select("key", "budget_id", F.col("high").alias("threshold"), (F.col("rest") >= F.col("size") / 2).alias("inclusive"))


def rules(sized: DataFrame, target: DataFrame, fractions: Sequence[float] = (1.0,)) -> DataFrame:
    """One row for each source: key, source_size, target, whole (times all is taken) and cut (the hash threshold for once more).

    whole and cut have an entry for each of ``fractions`` of the target; those mixes are nested.
    """
    target = materialise(target.select(key().alias("key"), "source_size", "target"), "mix-targets")
    times = [F.when(F.col("source_size") > 0, F.floor(F.col("target") * f / F.col("source_size"))).otherwise(0).cast("long") for f in fractions]
    left = F.array(*(F.struct(F.lit(k).alias("budget_id"), (F.col("target") * f - n * F.col("source_size")).alias("budget")) for k, (f, n) in enumerate(zip(fractions, times, strict=True))))
    cut = thresholds(sized, target.select("key", F.explode(left).alias("b")).select("key", "b.*").where("budget > 0"))
    cut = cut.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("budget_id", F.struct("threshold", "inclusive")))).alias("cut"))
    return materialise(target.join(cut, "key", "left").withColumn("whole", F.array(*times)), "mix-rules")


def copies(k: int = 0) -> Column:
    """How often mix number ``k`` takes a document, over ``hash`` and the columns of ``rules``."""
    cut = F.try_element_at("cut", F.lit(k))
    once_more = (F.col("hash") < cut["threshold"]) | (F.col("hash") == cut["threshold"]) & cut["inclusive"]
    return (F.col("whole")[k] + F.when(once_more, 1).otherwise(0)).cast("int")


def mix(sized: DataFrame, rules: DataFrame, k: int = 0) -> DataFrame:
    """``sized`` with source_size, target and ``copies``."""
    rows = sized.withColumn("key", key()).join(rules, "key")
    return rows.select(*sized.columns, "source_size", "target", copies(k).alias("copies"))


def repeat(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them: rows left out, once or repeated; same columns."""
    sized = materialise(sizes(docs), "mix-sizes")
    rule = rules(sized, targets(sized, **how))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, key().alias("key"), F.xxhash64("doc_id", "text").alias("hash")).join(rule, "key")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), copies()))).select("row.*")
