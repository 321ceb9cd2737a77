"""Queries over what comes in and what is kept: JSON records, pages of a service, a store with versions, and small reads of a report.

The texts that a source would deliver are made by Spark from the driver's tables, a line or an item for each row.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..keeping import folder
from ..operators import classify, drift, report
from ..sources import pages, records
from ..sources.store import ParquetStore
from . import catalog
from .catalog import BASE, EV, LIMITS, TR, query
from .lenses import event_traces, keep, table


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """line, value: of six events in turn a native record, an evaluation, a bare span, a torn line, an array, and spans that are no list."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    text = lambda name: F.lit(name)
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts")
    status = F.when(F.col("value") > 200, "TIMEOUT").otherwise(" ok ").alias("status")
    first = F.to_json(F.struct(text("llm").alias("stage"), F.col("value").alias("durationMs"), status, F.col("k").alias("tokensIn"), F.lit(0.25).alias("cost")))
    native = F.concat(F.lit('{"trace_id": "n-'), F.col("event_id").cast("string"), F.lit('", "ts": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('", "pipeline_name": "desk", "spans": ['), first, F.lit(', {"name": "rerank", "duration_ms": 1}]}'))
    hits = F.array(F.col("k") / 100, F.lit(0.5))
    asked = F.to_json(F.struct(ts, F.col("event_type").alias("query"), hits.alias("retrieved"), F.col("event_type").alias("answer"), F.col("value").alias("retrieval_ms")))
    bare = F.to_json(F.struct(ts, text("s").alias("span_id"), F.col("event_type").alias("stage"), F.lit(0.125).alias("cost"), F.col("k").alias("tokens_in")))
    kind = F.col("event_id") % 6
    value = F.when(kind == 0, native).when(kind == 1, asked).when(kind == 2, bare).when(kind == 3, F.concat(F.lit('{"trace_id": "'), "event_type")).when(kind == 4, F.concat(F.lit("["), F.col("k").cast("string"), F.lit("]"))).otherwise(F.to_json(F.struct(F.col("event_type").alias("spans"))))
    return e.select(F.col("event_id").alias("line"), value.alias("value"))


_KIND = "e AS (SELECT *, event_id % 6 AS kind, (props->>'$.k')::BIGINT AS k FROM events)"


@query(f"""WITH {_KIND} SELECT CASE kind WHEN 0 THEN 'n-' ELSE 'trace-l' END || event_id AS trace_id, ts::DATE AS day, CASE kind WHEN 0 THEN 'desk' ELSE 'unknown' END AS pipeline_name,
  CASE kind WHEN 0 THEN 0.25 WHEN 1 THEN 0 ELSE 0.125 END::DOUBLE AS total_cost, CASE kind WHEN 2 THEN 1 ELSE 2 END AS n_spans, CASE kind WHEN 0 THEN 'llm-0' WHEN 1 THEN 'trace-l' || event_id || '-retrieve' ELSE 's' END AS span_id,
  CASE kind WHEN 0 THEN 'generate' WHEN 1 THEN 'retrieve' ELSE 'tool' END AS stage, CASE WHEN kind = 0 AND value > 200 THEN 'timeout' ELSE 'ok' END AS status, CASE kind WHEN 2 THEN 0 ELSE value END::DOUBLE AS duration_ms,
  CASE kind WHEN 1 THEN 0 ELSE k END AS tokens_in, CASE kind WHEN 1 THEN round(k / 100 + 0.5, 6) END AS scores, CASE kind WHEN 1 THEN (4 * length(event_type))::INT END AS prompt_chars
FROM e WHERE kind < 3""")
def record_traces(spark, d):
    """Native records, evaluations and bare spans as traces."""
    first = F.col("spans")[0]
    scores = F.aggregate(first["attrs"]["hit_scores"], F.lit(0.0), lambda a, x: a + x)
    last = F.element_at("spans", -1)
    return records.parse_records(_lines(spark, d))[0].select(
        "trace_id", "day", "pipeline_name", "total_cost", F.size("spans").alias("n_spans"), *(first[c].alias(c) for c in ("span_id", "stage", "status", "duration_ms", "tokens_in")),
        F.round(scores, 6).alias("scores"), last["attrs"]["prompt_chars"].alias("prompt_chars"),
    )


@query(f"WITH {_KIND} SELECT CASE kind WHEN 3 THEN 'not JSON' WHEN 4 THEN 'not an object' ELSE 'spans are not a list of objects' END AS reason, count(*) AS n, min(event_id) AS first_line FROM e WHERE kind > 2 GROUP BY 1")
def record_rejects(spark, d):
    """Why lines were rejected."""
    return records.parse_records(_lines(spark, d))[1].groupBy("reason").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


#: Orders and lines of a page.
ORDERS_A_PAGE, LINES_A_PAGE = 400, 100


def _page(rows: DataFrame, number: Column, order: tuple[str, ...], item: Column) -> DataFrame:
    found = rows.groupBy(number.cast("int").alias("page")).agg(F.array_sort(F.collect_list(F.struct(*order, F.to_json(item).alias("item")))).alias("x"))
    return found.select("page", F.concat(F.lit('{"data": ['), F.array_join(F.transform("x", lambda x: x["item"]), ", "), F.lit("]}")).alias("value"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem WHERE l_orderkey % 7 <> 0),
s AS (SELECT l_orderkey, count(*)::INT AS n_spans, sum(l_tax) AS cost, sum(CASE WHEN l_discount > 0.08 THEN 0 ELSE l_quantity * 1000 END) AS ms, count(*) FILTER (l_linenumber = 3) AS timeouts, count(*) FILTER (l_returnflag = 'R' AND l_linenumber <> 3) AS errors,
  sum(l_suppkey) AS tokens, string_agg(CASE l_linenumber WHEN 1 THEN 'retrieve' WHEN 2 THEN 'generate' ELSE 'tool' END, ',' ORDER BY i) AS stages FROM l GROUP BY l_orderkey)
SELECT 'o-' || o_orderkey AS trace_id, o_orderdate::DATE AS day, o_orderpriority AS pipeline_name, coalesce(n_spans, 0) AS n_spans, round(coalesce(cost, 0), 6) AS total_cost, round(coalesce(ms, 0), 3) AS ms, coalesce(timeouts, 0)::INT AS timeouts, coalesce(errors, 0)::INT AS errors, coalesce(tokens, 0)::BIGINT AS tokens, coalesce(stages, '') AS stages FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def service_traces(spark, d):
    """Pages of orders as traces and pages of their lines as observations; a seventh of the lines belongs to no trace, and some end before they begin."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    item = F.struct(F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("o_orderpriority").alias("name"))
    traces = _page(orders, 1 + F.floor(F.col("o_orderkey") / ORDERS_A_PAGE), ("o_orderkey",), item)
    end = F.when(F.col("l_discount") > 0.08, F.lit(10.0)).otherwise(1000 + F.col("l_quantity"))
    seen = F.struct(
        F.when(F.col("l_orderkey") % 7 == 0, "").otherwise(F.concat(F.lit("o-"), F.col("l_orderkey").cast("string"))).alias("traceId"),
        F.when(F.col("l_linenumber") == 1, "retrieval").when(F.col("l_linenumber") == 2, "LLM").when(F.col("l_linenumber") == 3, "search Timeout").otherwise("step").alias("name"),
        F.when(F.col("l_returnflag") == "R", "error").otherwise("DEFAULT").alias("level"), F.lit("1000").alias("startTime"), end.cast("string").alias("endTime"),
        F.struct(F.col("l_suppkey").alias("input")).alias("usage"), F.col("l_tax").alias("calculatedTotalCost"),
    )
    observations = _page(lines, 1 + F.floor(F.col("l_orderkey") / LINES_A_PAGE), ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), seen)
    s = F.col("spans")
    count = lambda status: F.size(F.filter(s, lambda x: x["status"] == status))
    stages = F.array_join(F.transform(s, lambda x: F.when(x["name"] == "search Timeout", "tool").otherwise(x["stage"])), ",")
    total = lambda field, zero: F.aggregate(s, zero, lambda a, x: a + x[field])
    return pages.traces(traces, observations).select(
        "trace_id", "day", "pipeline_name", F.size(s).alias("n_spans"), F.round("total_cost", 6).alias("total_cost"), F.round(total("duration_ms", F.lit(0.0)), 3).alias("ms"),
        count("timeout").alias("timeouts"), count("error").alias("errors"), total("tokens_in", F.lit(0).cast("long")).alias("tokens"), stages.alias("stages"),
    )


#: The second batch brings the later half of the month anew, at twice its cost and without failures.
RENEWED = 16


def _store(spark: SparkSession, d: str) -> ParquetStore:
    traces = keep(event_traces(spark, d), "cohort")
    failures = classify.failures(traces, LIMITS)
    store = ParquetStore(spark, folder(spark, "store"), buckets=2)
    store.insert(traces, failures)
    again = traces.where(F.dayofmonth("day") >= RENEWED).withColumns({"total_cost": 2 * F.col("total_cost"), "pipeline_name": F.lit("again")})
    store.insert(again, failures.limit(0))
    return store


@query(f"""WITH {EV}, t AS (SELECT trace_id, day, min(ts) AS ts, sum(cost) AS cost, count(*)::INT AS n_spans FROM ev GROUP BY ALL), b AS (SELECT min(ts) AS first FROM t)
SELECT trace_id, day, CASE WHEN day(day) >= {RENEWED} THEN 'again' ELSE 'events' END AS pipeline_name, round(cost * CASE WHEN day(day) >= {RENEWED} THEN 2 ELSE 1 END, 6) AS total_cost, n_spans FROM t, b WHERE ts BETWEEN first + INTERVAL 10 DAY AND first + INTERVAL 20 DAY""")
def store_by_time(spark, d):
    """Ten days of a store in which a second batch replaced half of the traces; bounds from the first trace."""
    first: datetime = event_traces(spark, d).agg(F.min("ts")).head()[0]
    rows = _store(spark, d).by_time(first + timedelta(days=10), first + timedelta(days=20))
    return rows.select("trace_id", "day", "pipeline_name", F.round("total_cost", 6).alias("total_cost"), F.size("spans").alias("n_spans"))


@query(f"WITH {TR} SELECT day, taxonomy_id, count(*) AS n FROM fa WHERE day(day) < {RENEWED} GROUP BY ALL")
def store_failure_mix(spark, d):
    """Failures of replaced traces are gone with them."""
    return _store(spark, d).failure_mix_per_day()


@query(f"WITH {TR} SELECT count(*) AS n, 'events' AS pipelines, min(day) AS first_day, max(day) AS last_day FROM tr")
def report_header(spark, d):
    head = report.header(event_traces(spark, d))
    return head.select("n", F.array_join("pipelines", ",").alias("pipelines"), F.to_date("first").alias("first_day"), F.to_date("last").alias("last_day"))


@query(f"WITH {TR}, m AS (SELECT taxonomy_id, min(trace_id) AS trace_id FROM fa GROUP BY taxonomy_id), n AS (SELECT trace_id, count(*)::INT AS n_spans FROM ev GROUP BY trace_id) SELECT taxonomy_id, trace_id, n_spans, round(total_cost, 6) AS total_cost FROM m JOIN n USING (trace_id) JOIN tr USING (trace_id)")
def sample_traces(spark, d):
    """The trace of each class's sample."""
    traces = keep(event_traces(spark, d), "cohort")
    rows = report.sample_traces(traces, report.classes(classify.failures(traces, LIMITS)))
    return rows.select("taxonomy_id", "trace_id", F.size("spans").alias("n_spans"), F.round("total_cost", 6).alias("total_cost"))


@query(f"WITH {TR}, w AS (SELECT day FROM (SELECT DISTINCT day FROM fa) ORDER BY day LIMIT {BASE}) SELECT taxonomy_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM fa WHERE day IN (FROM w) GROUP BY taxonomy_id")
def stable_mix(spark, d):
    """The mix of the days before anything is compared with them."""
    failures = classify.failures(keep(event_traces(spark, d), "cohort"), LIMITS)
    grid = drift.daily_grid(classify.mix_per_day(failures))
    rows = drift.on_days(failures, grid.where(F.col("day_idx") <= BASE))
    return classify.mix(rows).withColumn("share", F.round("share", 6))


_WORDS = [w for words in classify.KEYWORDS.values() for w in words]
_PICK = f"w[1 + k % {len(_WORDS)}] || ', ' || upper(w[1 + event_id % {len(_WORDS)}]) || w[1 + event_id % {len(_WORDS)}]"


@query(f"""WITH kw AS (SELECT * FROM (VALUES {catalog._KW}) v(words, id)), e AS (SELECT event_id, lower(event_type || ' ' || {_PICK.replace('k %', "(props->>'$.k')::BIGINT %")}) AS t FROM events, (SELECT {catalog._LIST(_WORDS)} AS w)),
s AS (SELECT event_id, id, list_sum(list_transform(words, lambda w: (length(t) - length(replace(t, w, ''))) // length(w))) AS n FROM e, kw)
SELECT event_id, arg_min(id, (-n, id)) AS taxonomy_id, round(least(0.75, 0.40 + 0.05 * max(n)), 6)::DOUBLE AS confidence FROM s GROUP BY event_id HAVING max(n) > 0""")
def keyword_score_events(spark, d):
    """Verdicts by keywords, over texts that name two of them in turn."""
    e = table(spark, d, "events").withColumn("w", F.array(*map(F.lit, _WORDS)))
    one, two = (F.get(F.col("w"), (x % len(_WORDS)).cast("int")) for x in (F.get_json_object("props", "$.k").cast("long"), F.col("event_id")))
    text = F.concat("event_type", F.lit(" "), one, F.lit(", "), F.upper(two), two)
    rows = classify.keyword_verdicts(e, "event_id", text)
    return rows.select("event_id", "v.taxonomy_id", F.round("v.confidence", 6).cast("double").alias("confidence"))


#: The series of the lower incomplete gamma function, in logarithms.
catalog.ORACLE_SQL["chi_square_p_all"] = f"""WITH {catalog._WINDOWS} SELECT day, round(chi2, 6) AS chi2, df::INT AS df,
  CASE WHEN df < 1 THEN NULL WHEN chi2 <= 0 THEN 1.0 WHEN chi2 > 2000 THEN 0.0 ELSE round(greatest(0, 1 - list_sum(list_transform(range(3000), lambda i: exp((df / 2 + i) * ln(chi2 / 2) - chi2 / 2 - lgamma(df / 2 + i + 1))))), 6) END::DOUBLE AS p FROM ch"""
