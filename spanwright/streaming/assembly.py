"""Traces from spans that arrive over several requests.

A trace is written when none of its spans has arrived for a while, and again, with the next revision, when one comes later. The
state of a trace is a handful of numbers; the spans themselves stay in what ``intake`` wrote, and a trace is built from the
batches in which its spans arrived. Time is that of arrival, by the clock of the micro-batch: no span is too late.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..schema import TRACES
from ..sources import otlp
from . import intake

READY = "trace_id string, revision int, n_spans long, late_spans long, first_batch int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocks(spark: SparkSession) -> None:
    """Timers and typed states need this state store; queries that run already keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Quiet(StatefulProcessor):
    """For a trace: a row of ``READY`` once nothing has arrived for ``quiet_ms``."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "n_spans long, late_spans long, first_batch int, due long, revision int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, late, first, due, revision = self.known.get() if self.known.exists() else (0, 0, None, 0, 0)
        for batch in rows:
            n, late = n + len(batch), late + len(batch) * (revision > 0)
            first = int(min(batch["batch"].min(), first if first is not None else batch["batch"].min()))
            due = max(due, int(batch["seen"].max().timestamp() * 1000) + self.quiet_ms)
        self.known.update((n, late, first, due, revision))
        self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        n, late, first, due, revision = self.known.get()
        if expiredTimerInfo.getExpiryTimeInMs() >= due:  # else more has arrived since
            self.known.update((n, late, first, due, revision + 1))
            yield pd.DataFrame([(key[0], revision + 1, n, late, first)], columns=["trace_id", "revision", "n_spans", "late_spans", "first_batch"])

    def close(self) -> None:
        pass


def assemble(spark: SparkSession, out: str, checkpoint: str, quiet_s: float = 600) -> StreamingQuery:
    """Adds to ``out``/traces the traces among ``intake``'s spans to which nothing was added for ``quiet_s`` seconds.

    With 0 each run ends with all its traces written.
    """
    with_rocks(spark)

    def build(ready: DataFrame, number: int) -> None:
        ready = ready.persist()  # read twice
        first = ready.agg(F.min("first_batch")).first()[0]
        if first is not None:
            spans = intake.spans(spark, out).where(F.col("batch") >= first).join(ready.select("trace_id"), "trace_id", "left_semi")
            rows = otlp.traces(spans).join(ready.drop("first_batch"), "trace_id")
            rows.write.mode("overwrite").parquet(f"{out}/traces/batch={number}")
        ready.unpersist()

    arrived = spark.readStream.schema(intake.ENTRIES).option("ignoreMissingFiles", True).parquet(f"{out}/intake").where("kind = 'span'").select("trace_id", "batch")
    timed = arrived.withColumn("seen", F.current_timestamp()).withWatermark("seen", "0 seconds")
    ready = timed.groupBy("trace_id").transformWithStateInPandas(Quiet(int(quiet_s * 1000)), outputStructType=READY, outputMode="append", timeMode="EventTime")
    return ready.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def traces(spark: SparkSession, out: str) -> DataFrame:
    """The last revision of each trace, as ``otlp.traces`` gives it, with revision, n_spans and late_spans (those after the first revision)."""
    schema = f"{TRACES}, meta struct<scopes array<string>, resource map<string,string>>, revision int, n_spans long, late_spans long, batch int"
    try:
        rows = spark.read.schema(schema).parquet(f"{out}/traces")
    except Exception as e:  # only a missing folder means that no trace was written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], schema)
    newest = Window.partitionBy("trace_id").orderBy(F.desc("revision"), F.desc("batch"))
    return rows.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n", "batch")
