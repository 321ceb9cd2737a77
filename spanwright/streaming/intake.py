"""Exports that arrive as files, as a stream: parsed once, kept once, none lost.

A receiver (outside Spark) drops each request as one file in a folder. ``intake`` reads new files and keeps every span once, however
late it comes and whether or not it has a start, and beside the spans, in the same commit, what could not be read. Repeats are
known by the keys that the state store holds, without a watermark: so no arrival is dropped for its age, and the state
grows with the spans. ``assembly`` makes traces of the spans, ``watch`` looks for drift.
All queries work by micro-batches, end by themselves under ``available_now``, and resume from their checkpoint folder: a
micro-batch writes a folder of its own, which a repeat after a crash replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import SPAN
from ..sources import otlp

#: How late a failure may be that is counted by windows.
LATE = "10 minutes"
_SPAN = ", ".join(x for x in SPAN.split(", attrs ")[0].split(", ") if not x.startswith("pos ")) + ", attrs" + SPAN.split(", attrs", 1)[1]
#: What ``intake`` writes; batch and kind (span, skipped) are folders.
ENTRIES = f"level string, reason string, doc string, place array<int>, trace_id string, start_ns bigint, service string, scope string, resource map<string,string>, {_SPAN}, arrived timestamp, batch int, kind string"


def exports(spark: SparkSession, folder: str, files: int = 1000, archive: str | None = None) -> DataFrame:
    """doc (path), value of each file in ``folder``, at most ``files`` a batch; read files go to ``archive``, if given."""
    reader = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder).select(F.col("_metadata.file_path").alias("doc"), "value")


def once(entries: DataFrame) -> DataFrame:
    """A stream of ``otlp.spans(..., with_skipped=True)``: each span once, by trace and span id, each skipped entry once, by its place."""
    lost = F.col("reason").isNotNull()
    key = F.when(lost, F.concat_ws("/", "doc", F.array_join(F.col("place").cast("array<string>"), "."))).otherwise(F.concat_ws(" ", "trace_id", "span_id"))
    return entries.withColumns({"__key": key, "kind": F.when(lost, "skipped").otherwise("span")}).dropDuplicates(["__key"]).drop("__key")


def intake(spark: SparkSession, folder: str, out: str, checkpoint: str, **source: int | str) -> StreamingQuery:
    """Adds the spans and the skipped entries of new files to ``out``/intake; read them with ``spans`` and ``skipped``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{out}/intake/batch={number}")

    found = once(otlp.spans(otlp.entries(exports(spark, folder, **source)), with_skipped=True)).withColumn("arrived", F.current_timestamp())
    return found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _taken_in(spark: SparkSession, out: str) -> DataFrame:
    try:
        return spark.read.schema(ENTRIES).parquet(f"{out}/intake")
    except Exception as e:  # only a missing folder means that nothing came yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ENTRIES)


def spans(spark: SparkSession, out: str) -> DataFrame:
    """All spans that came, as ``otlp.spans`` gives them, with arrived and batch."""
    return _taken_in(spark, out).where("kind = 'span'").drop("level", "reason", "kind")


def skipped(spark: SparkSession, out: str) -> DataFrame:
    """level, reason, doc, place, batch of all entries that could not be read."""
    return _taken_in(spark, out).where("kind = 'skipped'").select("level", "reason", "doc", "place", "batch")


def counts(spark: SparkSession, out: str, late_s: int = 600) -> DataFrame:
    """batch, spans, undated (without a start), late (``late_s`` older than the newest start of earlier batches), skipped."""
    rows = _taken_in(spark, out)
    newest = rows.groupBy("batch").agg(F.max("start_ns").alias("newest"))
    before = F.max("newest").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1))  # a row for each batch
    rows = rows.join(newest.select("batch", before.alias("before")), "batch")
    is_span = F.col("kind") == "span"
    n = lambda test: F.sum(F.when(test, 1).otherwise(0))
    late = is_span & F.coalesce(F.col("start_ns") < F.col("before") - late_s * 1_000_000_000, F.lit(False))
    return rows.groupBy("batch").agg(n(is_span).alias("spans"), n(is_span & F.col("start_ns").isNull()).alias("undated"), n(late).alias("late"), n(~is_span).alias("skipped"))


def mix_by_window(failures: DataFrame, width: str = "1 day", slide: str | None = None, late: str = LATE) -> DataFrame:
    """start, taxonomy_id, n over windows of ``width`` (daily; or sliding, as three days by one) of failures (ts, taxonomy_id)."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return failures.withWatermark("ts", late).groupBy(window.alias("w"), "taxonomy_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "taxonomy_id", "n")


def available_now(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs over what there is, to Parquet, and ends: one turn of a watch."""
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
