"""Titles, stages, fixes and checks of failure classes as a table: the built-in ones, with entries of a file in their place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EXPECTED_GUARDS, PLAYBOOKS, STAGES, TAXONOMY

ENTRIES = "taxonomy_id string, title string, stage string, fix string, expected string"
_NAMES = [x.split()[0] for x in ENTRIES.split(", ")]
#: A file of more classes than this is taken for something else.
MOST = 10_000


class OverrideError(ValueError):
    """A file of entries that does not hold what it should."""


def built_in(spark: SparkSession) -> DataFrame:
    """``ENTRIES`` of the classes that the rules know."""
    return spark.createDataFrame([(c, title, stage, PLAYBOOKS.get(c), EXPECTED_GUARDS.get(c)) for c, (title, stage) in TAXONOMY.items()], ENTRIES)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a file: CSV with a header, JSON lines, or a JSON array of objects. Each is checked; columns may be missing, but no others may be there.

    A class must have an id and only one entry; a stage must be one of the model's; at most ``MOST`` entries.
    """
    plain = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.option("multiLine", path.endswith(".json")).json(path)
    other = sorted(set(plain.columns) - set(_NAMES))
    if other or "taxonomy_id" not in plain.columns:
        raise OverrideError(f"{path}: " + (f"unknown columns {', '.join(other)}" if other else "there is no column taxonomy_id"))
    rows = plain.select(*((F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) if n in plain.columns else F.lit(None).cast("string")).alias(n) for n in _NAMES))
    found = rows.agg(
        F.count("*").alias("n"), F.sum(F.col("taxonomy_id").isNull().cast("int")).alias("nameless"), F.count_distinct("taxonomy_id").alias("ids"), F.first(F.when(~F.col("stage").isin(*STAGES), F.col("stage")), ignorenulls=True).alias("stage")
    ).first()
    faults = [
        (found.n > MOST, f"more than {MOST} entries"), (found.nameless, "an entry without taxonomy_id"), (found.n and found.ids + (found.nameless or 0) < found.n, "two entries of one class"), (found.stage, f"{found.stage} is not a stage"),
    ]
    for bad, what in faults:
        if bad:
            raise OverrideError(f"{path}: {what}")
    return rows


def entries(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``ENTRIES``: the built-in ones; what a file's entry says goes before, what it leaves out stays."""
    base = built_in(spark)
    if path is None:
        return base
    own = read(spark, path)
    return base.alias("b").join(own.alias("o"), "taxonomy_id", "full").select("taxonomy_id", *(F.coalesce(f"o.{n}", f"b.{n}").alias(n) for n in _NAMES[1:]))
