"""Results as single files that are equal byte by byte whenever the results are.

Files are written aside and renamed, so a reader sees the old or the new one. They are for what people read and compare: one task
writes them in order. Cohorts belong in a store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType

from . import files


def _fixed(value: Column, kind: DataType) -> Column:
    """Numbers to 6 places, without minus zero."""
    return F.round(value, 6) + F.lit(0.0) if isinstance(kind, DoubleType | FloatType) else value


def canonical(df: DataFrame) -> DataFrame:
    """value: each row as JSON with its columns in order; nulls are written."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return df.select(F.to_json(F.struct(*(_fixed(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields)), {"ignoreNullFields": "false"}).alias("value"))


def write_rows(df: DataFrame, path: str) -> None:
    """JSON lines of ``df``, sorted as text, as the one file ``path``."""
    spark = df.sparkSession
    aside = f"{path}.{uuid.uuid4().hex}"
    canonical(df).repartition(1).sortWithinPartitions("value").write.text(aside)
    part = next(n for n in files.names(spark, aside) if n.startswith("part-"))
    files.replace(spark, f"{aside}/{part}", path)
    files.delete(spark, aside)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A text as the file ``path``."""
    aside = f"{path}.{uuid.uuid4().hex}"
    files.create(spark, aside, text if text.endswith("\n") else text + "\n")
    files.replace(spark, aside, path)
