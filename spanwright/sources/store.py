"""Stores of traces, spans and failures.

``ParquetStore`` keeps three tables under one version. An insert writes the rows of a batch to folders of its own and then names
these folders in the next manifest; the manifest is the only thing that makes them part of the store. So a writer that dies halfway leaves
the last version as it was, two writers at once give two versions, and any version can be read later. A batch replaces earlier rows
of its traces: readers keep the newest copy of each trace, which costs a join only after a batch that replaced something, until ``compact``.
Folders lie by day and by a hash of the trace id, with Parquet's bloom filters on the id; a look-up opens one bucket.

``LinesStore`` keeps traces and failures as JSON lines. ``open_store`` chooses by the path.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.classify import mix_per_day
from ..schema import SPAN, TRACES
from . import files

FAILURES = "trace_id string, day date, taxonomy_id string, stage string, confidence double, source string, evidence array<struct<span_id string, stage string, key string, value string, note string>>"
HEADERS = "trace_id string, ts timestamp, day date, pipeline_name string, total_cost double, meta string"
SPANS = f"trace_id string, day date, {SPAN}"
SCHEMAS = {"traces": HEADERS, "spans": SPANS, "failures": FAILURES}
_SPAN_NAMES = [x.split()[0] for x in SPAN.split(", attrs ")[0].split(", ")] + ["attrs"]


class StoreError(ValueError):
    """A store that cannot be read."""


class TraceStore(Protocol):
    """What the operators need of a store."""

    @property
    def traces(self) -> DataFrame: ...
    @property
    def failures(self) -> DataFrame: ...
    def insert(self, traces: DataFrame, failures: DataFrame) -> None: ...
    def by_time(self, start: datetime, end: datetime) -> DataFrame: ...
    def get(self, trace_id: str) -> DataFrame: ...
    def spans_by_trace(self, trace_id: str) -> DataFrame: ...
    def failure_mix_per_day(self) -> DataFrame: ...
    def count_traces(self) -> int: ...


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def first_copies(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows with one key the first; all columns."""
    packed = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r"))
    return packed.select("r.*")


def _inside(start: datetime, end: datetime) -> Column:
    return F.col("day").between(F.lit(start.date()), F.lit(end.date())) & F.col("ts").between(F.lit(start), F.lit(end))


def _one_each(traces: DataFrame) -> DataFrame:
    """Of the copies of a trace within a batch the one with the latest time."""
    order = Window.partitionBy("trace_id").orderBy(F.desc_nulls_last("ts"), F.desc("total_cost"))
    return traces.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


@dataclass(frozen=True)
class ParquetStore:
    """``path``: a folder that driver and executors share. ``version``: the one to read (None: the newest)."""

    spark: SparkSession
    path: str
    buckets: int = 16
    version: int | None = None

    # --- versions ------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in files.names(self.spark, f"{self.path}/_versions") if n.endswith(".json")]

    def at(self, version: int) -> ParquetStore:
        """The store as it was."""
        return ParquetStore(self.spark, self.path, self.buckets, version)

    def _manifest(self) -> tuple[int, list[dict]]:
        """Number and commits (folder, buckets, replaces), oldest first; nothing is version 0."""
        known = self.versions()
        number = self.version if self.version is not None else max(known, default=0)
        if number == 0:
            return 0, []
        if number not in known:
            raise StoreError(f"there is no version {number}")
        return number, json.loads(files.read(self.spark, f"{self.path}/_versions/{number:012d}.json"))

    def _publish(self, number: int, commits: list[dict]) -> bool:
        return files.create(self.spark, f"{self.path}/_versions/{number:012d}.json", json.dumps(commits, sort_keys=True))

    # --- writing -------------------------------------------------------------------------------

    def _bucket(self, trace_id: Column) -> Column:
        return F.pmod(F.xxhash64(trace_id), F.lit(self.buckets)).cast("int")

    def _write(self, folder: str, **tables: DataFrame) -> None:
        for name, rows in tables.items():
            rows = rows.withColumn("bucket", self._bucket(F.col("trace_id"))).repartition("day", "bucket").sortWithinPartitions("day", "bucket", "trace_id")
            rows.write.option("parquet.bloom.filter.enabled#trace_id", "true").partitionBy("day", "bucket").parquet(f"{self.path}/{name}/commit={folder}")

    def insert(self, traces: DataFrame, failures: DataFrame) -> None:
        """Adds a batch; traces that are there already are replaced, with their spans and failures."""
        own = _one_each(traces)
        meta = F.to_json("meta") if "meta" in traces.columns and traces.schema["meta"].dataType.typeName() != "string" else F.col("meta") if "meta" in traces.columns else F.lit(None).cast("string")
        folder = uuid.uuid4().hex
        spans = own.select("trace_id", "day", F.explode("spans").alias("s")).select("trace_id", "day", *(f"s.{c}" for c in _SPAN_NAMES))
        self._write(folder, traces=own.select("trace_id", "ts", "day", "pipeline_name", "total_cost", meta.alias("meta")), spans=spans, failures=failures.select(*(x.split()[0] for x in FAILURES.split(", evidence")[0].split(", ")), "evidence"))
        newest = ParquetStore(self.spark, self.path, self.buckets)
        while True:
            number, commits = newest._manifest()
            mine = newest._table("traces", [{"folder": folder}]).select("trace_id")
            replaces = bool(commits) and not newest._table("traces", commits).join(mine, "trace_id", "left_semi").isEmpty()
            if newest._publish(number + 1, [*commits, {"folder": folder, "replaces": replaces}]):
                return

    def compact(self) -> None:
        """Writes what is live as one commit; a version that another writer adds meanwhile stands, and this one is given up."""
        number, commits = self._manifest()
        folder = uuid.uuid4().hex
        self._write(folder, **{name: self._live(name).drop("bucket") for name in SCHEMAS})
        self._publish(number + 1, [{"folder": folder, "replaces": False}])

    def vacuum(self, keep: int = 1) -> None:
        """Deletes the folders of commits that none of the last ``keep`` versions names. Not while others write."""
        known = self.versions()
        used = {c["folder"] for n in known[-keep:] for c in self.at(n)._manifest()[1]}
        for n in known[:-keep]:
            files.delete(self.spark, f"{self.path}/_versions/{n:012d}.json")
        for table in SCHEMAS:
            for name in files.names(self.spark, f"{self.path}/{table}"):
                if name.removeprefix("commit=") not in used:
                    files.delete(self.spark, f"{self.path}/{table}/{name}")

    # --- reading -------------------------------------------------------------------------------

    def _table(self, name: str, commits: list[dict]) -> DataFrame:
        """All rows of some commits, with commit and bucket."""
        schema = f"{SCHEMAS[name]}, bucket int, commit string"
        if not commits:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/commit={c['folder']}" for c in commits))

    def _live(self, name: str, only: Column | None = None) -> DataFrame:
        """Rows of the newest copy of each trace, with bucket; ``only`` is a condition on trace_id and bucket."""
        _, commits = self._manifest()
        rows = self._table(name, commits)
        rows = rows if only is None else rows.where(only)
        if any(c["replaces"] for c in commits):
            order = F.create_map(*(F.lit(x) for k, c in enumerate(commits) for x in (c["folder"], k)))
            ids = self._table("traces", commits)
            ids = ids if only is None else ids.where(only)
            newest = ids.groupBy("trace_id").agg(F.max(order[F.col("commit")]).alias("__newest"))
            rows = rows.join(newest, "trace_id", "left").where(F.coalesce(order[F.col("commit")] >= F.col("__newest"), F.lit(True))).drop("__newest")
        return rows.drop("commit")

    @property
    def headers(self) -> DataFrame:
        """``HEADERS``: the traces without their spans."""
        return self._live("traces").drop("bucket")

    @property
    def spans(self) -> DataFrame:
        """A row for each span."""
        return self._live("spans").drop("bucket")

    @property
    def failures(self) -> DataFrame:
        return self._live("failures").drop("bucket")

    @property
    def traces(self) -> DataFrame:
        """Traces of the model, with meta (JSON)."""
        return self._assembled(self._live("traces"), self._live("spans"))

    def _assembled(self, headers: DataFrame, spans: DataFrame) -> DataFrame:
        # both tables of a trace lie in one day and bucket
        grouped = spans.groupBy("trace_id", "day", "bucket").agg(F.array_sort(F.collect_list(F.struct(*_SPAN_NAMES)), lambda a, b: a["pos"] - b["pos"]).alias("spans"))
        rows = headers.join(grouped, ["trace_id", "day", "bucket"], "left")
        none = F.array().cast(f"array<struct<{SPAN}>>")
        return rows.select(*(x.split()[0] for x in TRACES.split(", spans")[0].split(", ")), F.coalesce("spans", none).alias("spans"), "meta")

    def by_time(self, start: datetime, end: datetime) -> DataFrame:
        """Traces from ``start`` to ``end``, both included, in order; only their days are read."""
        days = F.col("day").between(F.lit(start.date()), F.lit(end.date()))
        return self._assembled(self._live("traces").where(_inside(start, end)), self._live("spans").where(days)).orderBy("ts", "trace_id")

    def _of(self, trace_id: str) -> Column:
        return (F.col("trace_id") == trace_id) & (F.col("bucket") == self._bucket(F.lit(trace_id)))

    def get(self, trace_id: str) -> DataFrame:
        """One trace, or no row; files of one bucket are opened."""
        return self._assembled(self._live("traces", self._of(trace_id)), self._live("spans", self._of(trace_id)))

    def spans_by_trace(self, trace_id: str) -> DataFrame:
        return self._live("spans", self._of(trace_id)).drop("bucket").orderBy("pos")

    def failure_mix_per_day(self) -> DataFrame:
        """day, taxonomy_id, n over the traces' failures."""
        return mix_per_day(self.failures)

    def count_traces(self) -> int:
        return self.headers.count()


@dataclass(frozen=True)
class LinesStore:
    """JSON lines, appended to: ``traces`` and ``failures`` in the folder ``path``. A line that cannot be read is an error; a repeated trace counts once, the first copy."""

    spark: SparkSession
    path: str

    def _read(self, name: str, schema: str) -> DataFrame:
        if not files.names(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        lines = self.spark.read.text(f"{self.path}/{name}").select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at")).where("trim(value) <> ''")
        row = F.from_json("value", schema, {"mode": "PERMISSIVE"})
        whole = F.try_parse_json("value").isNotNull() & row["trace_id"].isNotNull()
        bad = F.raise_error(F.concat(F.lit(f"{name}: cannot read in "), F.col("file"), F.lit(": "), F.substring("value", 1, 80)))
        return lines.select(F.when(whole, row).otherwise(bad).alias("r"), "file", "at").select("r.*", "file", "at")

    @property
    def traces(self) -> DataFrame:
        rows = self._read("traces", TRACES)
        if "file" not in rows.columns:
            return rows
        first = Window.partitionBy("trace_id").orderBy("file", "at")
        return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "file", "at")

    @property
    def failures(self) -> DataFrame:
        return self._read("failures", FAILURES).drop("file", "at")

    def insert(self, traces: DataFrame, failures: DataFrame) -> None:
        """Appends a batch."""
        for name, rows in (("traces", traces), ("failures", failures)):
            rows.select(F.to_json(F.struct("*"))).write.mode("append").text(f"{self.path}/{name}")

    def by_time(self, start: datetime, end: datetime) -> DataFrame:
        return self.traces.where(_inside(start, end)).orderBy("ts", "trace_id")

    def get(self, trace_id: str) -> DataFrame:
        return self.traces.where(F.col("trace_id") == trace_id)

    def spans_by_trace(self, trace_id: str) -> DataFrame:
        return self.get(trace_id).select("trace_id", "day", F.explode("spans").alias("s")).select("trace_id", "day", *(f"s.{c}" for c in _SPAN_NAMES)).orderBy("pos")

    def failure_mix_per_day(self) -> DataFrame:
        return mix_per_day(self.failures)

    def count_traces(self) -> int:
        return self.traces.count()


def open_store(spark: SparkSession, path: str) -> TraceStore:
    """A store of JSON lines for a path that ends in ``.lines`` or holds such lines already, else of Parquet."""
    plain = path.rstrip("/")
    first = [n for n in files.names(spark, f"{plain}/traces") if n.endswith((".txt", ".json", ".jsonl"))]
    return LinesStore(spark, plain) if plain.endswith(".lines") or first else ParquetStore(spark, plain)
