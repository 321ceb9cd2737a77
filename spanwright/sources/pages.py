"""Traces from an observability service with paged JSON: ``{"data": [...]}`` by page of traces and of observations.

``Pages`` is a Spark data source whose partitions are pages: executors fetch them side by side, each with retries of its own, and a page
that is lost with its executor is fetched again. With ``recorded`` it reads a folder of recorded pages instead, without a network.

    spark.dataSource.register(Pages)
    spark.read.format("pages").option("url", ...).option("kind", "traces").option("limit", 500).load()

``fetch`` reads both kinds and gives traces of the model.
"""

from __future__ import annotations

import base64
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.stages import normalize_stage, parse_time
from ..schema import ATTRS, SPAN
from .records import IngestError

PAGE = "page int, value string"
#: Answers of the service after which the same request may succeed.
AGAIN = (408, 429, 500, 502, 503, 504)
_TRACE = "id string, timestamp string, name string, release string, tags array<string>"
_OBSERVATION = "id string, traceId string, parentObservationId string, name string, type string, level string, startTime string, endTime string, usage string, calculatedTotalCost double, cost double, metadata string"


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class Reader(DataSourceReader):
    """Options: kind (path below ``url``), limit (of items), page_size, timeout and wait (seconds), retries; url, user, secret or recorded."""

    def __init__(self, options: dict[str, str]):
        self.kind = options.get("kind", "traces")
        self.limit, self.size = int(options.get("limit", 100)), int(options.get("page_size", 100))
        self.timeout, self.retries, self.wait = float(options.get("timeout", 15)), int(options.get("retries", 3)), float(options.get("wait", 0.5))
        self.recorded, self.url = options.get("recorded"), options.get("url", "").rstrip("/")
        self.user, self.secret = options.get("user", ""), options.get("secret", "")
        if self.limit < 0 or self.size < 1:
            raise IngestError("limit must not be negative, and a page needs room for an item")
        if not self.recorded and not (self.url and self.user and self.secret):
            raise IngestError("the service needs url, user and secret")

    def partitions(self) -> list[Page]:
        return [Page(k) for k in range(1, -(-self.limit // self.size) + 1)]

    def read(self, partition: Page) -> Iterator[tuple[int, str]]:
        text = self._recorded(partition.number) if self.recorded else self._fetched(partition.number)
        if text is None:
            return
        left = self.limit - (partition.number - 1) * self.size
        page = json.loads(text)
        items = page.get("data", []) if isinstance(page, dict) else page
        yield partition.number, json.dumps(items[: min(left, self.size)])

    def _recorded(self, number: int) -> str | None:
        path = os.path.join(self.recorded, f"{self.kind}-{number}.json")
        if not os.path.exists(path):
            return None  # past the last page
        with open(path, encoding="utf-8") as f:
            return f.read()

    def _fetched(self, number: int) -> str:
        query = urllib.parse.urlencode({"page": number, "limit": self.size})
        request = urllib.request.Request(f"{self.url}/{self.kind}?{query}", headers={"Authorization": "Basic " + base64.b64encode(f"{self.user}:{self.secret}".encode()).decode(), "Accept": "application/json"})
        for turn in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return answer.read().decode()
            except urllib.error.HTTPError as e:
                if e.code not in AGAIN or turn == self.retries:
                    raise IngestError(f"page {number} of {self.kind}: the service answered {e.code}") from None
            except (urllib.error.URLError, TimeoutError) as e:
                if turn == self.retries:
                    raise IngestError(f"page {number} of {self.kind}: {e}") from None
            time.sleep(self.wait * 2**turn)
        raise AssertionError


class Pages(DataSource):
    """``PAGE``: the items of each page, as a JSON array."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))


def items(pages: DataFrame, schema: str) -> DataFrame:
    """page, i (place in the page), item, of pages whose value is an array or an object with ``data``."""
    value = F.coalesce(F.get_json_object("value", "$.data"), F.col("value"))
    return pages.select("page", F.posexplode(F.from_json(value, f"array<struct<{schema}>>")).alias("i", "item"))


def traces(trace_pages: DataFrame, observation_pages: DataFrame) -> DataFrame:
    """Traces of the model, with meta (release, tags), from pages of traces and of observations.

    Spans are the observations of a trace, in the order of pages; those without a trace are left out. A trace without a time has
    the time of reading.
    """
    o = items(observation_pages, _OBSERVATION).where("item.traceId <> ''").select("page", "i", "item.*")
    name = F.coalesce("name", "type", F.lit("span"))
    status = F.when(F.lower(name).contains("timeout"), "timeout").when(F.upper("level") == "ERROR", "error").otherwise("ok")
    micros = F.unix_micros(parse_time(F.col("endTime"))) - F.unix_micros(parse_time(F.col("startTime")))
    used = lambda key: F.coalesce(F.get_json_object("usage", f"$.{key}").try_cast("bigint"), F.lit(0).cast("bigint"))
    span = F.struct(
        F.lit(0).alias("pos"), F.coalesce("id", F.concat(name, F.lit("-"), F.col("i").cast("string"))).alias("span_id"), F.col("parentObservationId").alias("parent_id"), name.alias("name"), normalize_stage(name).alias("stage"),
        F.coalesce(F.greatest(F.lit(0.0), micros / 1000), F.lit(0.0)).alias("duration_ms"), status.alias("status"), used("input").alias("tokens_in"), used("output").alias("tokens_out"),
        F.coalesce("calculatedTotalCost", "cost", F.lit(0.0)).alias("cost"), F.coalesce(F.from_json(F.when(F.ltrim("metadata").startswith("{"), F.col("metadata")), f"struct<{ATTRS}>"), F.from_json(F.lit("{}"), f"struct<{ATTRS}>")).alias("attrs"),
    ).cast(f"struct<{SPAN}>")
    first = lambda a, b: F.when(a["page"] != b["page"], a["page"] - b["page"]).otherwise(a["i"] - b["i"])
    own = o.groupBy(F.col("traceId").alias("trace_id")).agg(F.array_sort(F.collect_list(F.struct("page", "i", span.alias("s"))), first).alias("o"))
    t = items(trace_pages, _TRACE).select("page", "i", "item.*")
    trace_id = F.coalesce(F.nullif("id", F.lit("")), F.concat_ws("-", F.lit("page"), "page", "i"))
    ts = F.coalesce(parse_time(F.col("timestamp")), F.current_timestamp())
    rows = t.select(trace_id.alias("trace_id"), ts.alias("ts"), F.coalesce("name", F.lit("unknown")).alias("pipeline_name"), F.struct("release", F.coalesce("tags", F.array().cast("array<string>")).alias("tags")).alias("meta")).join(own, "trace_id", "left")
    spans = F.coalesce(F.transform("o", lambda x, i: x["s"].withField("pos", i)), F.array()).cast(f"array<struct<{SPAN}>>")
    rows = rows.select("trace_id", "ts", F.to_date("ts").alias("day"), "pipeline_name", spans.alias("spans"), "meta")
    cost = F.aggregate("spans", F.lit(0.0), lambda a, s: a + s["cost"])
    return rows.select("trace_id", "ts", "day", "pipeline_name", cost.alias("total_cost"), "spans", "meta")


def fetch(spark: SparkSession, limit: int = 100, **options: str | int | float) -> DataFrame:
    """``traces`` of the newest ``limit`` traces and ten times as many observations; ``options`` as for ``Reader``."""
    spark.dataSource.register(Pages)
    options = {k: str(v) for k, v in options.items()}
    Reader(options | {"limit": str(limit)})  # options are checked here, not in a task
    of = lambda kind, n: spark.read.format("pages").options(**options, kind=kind, limit=str(n)).load()
    return traces(of("traces", limit), of("observations", 10 * limit))
