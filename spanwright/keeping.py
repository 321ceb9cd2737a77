"""Tables that are read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once for several uses: a table in the folder that driver and executors share, or cached where none is named (tests)."""
    root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not root:
        return df.persist()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """The same rows out of a generator, so that later filters and columns take the values as they are instead of computing them anew."""
    one = df.select(F.explode(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))).alias("__row"))
    return one.select(*(F.col(f"__row.`{c}`").alias(c) for c in df.columns))


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share; in local mode without one (tests), a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        return f"{tempfile.mkdtemp(prefix='spanwright-')}/{name}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
