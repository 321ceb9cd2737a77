"""From raw documents to packed training sequences: five stages, each one operator on all that the stage before kept.

Defined results: null, empty and too short texts go with the quality rules; of equal rows, and of rows without an id that
share a text, one stays; a null source is a source of its own; an empty table gives an empty table; other columns, whatever their names,
are kept up to the packing, which returns pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanwright.llm import best_fit_packing, minhash_dedup, quality_rules, source_mix, suffix_dedup
from spanwright.llm._shared import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go."""
    return quality_rules.quality_filter(docs, "web-1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash_dedup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start more than once go from the texts."""
    return suffix_dedup.remove_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source comes near its target: documents stay out, stay, or come twice."""
    return source_mix.repeat(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 2048 tokens."""
    return best_fit_packing.pack(best_fit_packing.pieces(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]

#: Hashes, sketches and tokens are not SQL. Tests hold the operators against brute force and each stage against what it is to do.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
