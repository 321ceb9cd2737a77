"""Queries that plant failures on requests taken from the tables, and hold the operators against that truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blame, classify, drift, quality
from ..sources import planted
from .catalog import query
from .lenses import keep, table

SEED = 42


def _case(which: int) -> str:
    return "CASE " + " ".join(f"WHEN u < {t[which]} THEN '{t[0]}'" for t in planted.thresholds()) + " END"


#: Each order is a request; the draw that decides its failure, from the same hash.
PLANTED = f"""WITH r AS (SELECT 1 + o_orderkey % 28 AS day_no, o_orderkey AS number FROM orders),
u AS (SELECT *, ('0x' || left(md5(concat_ws('/', '{SEED}', day_no, number, 'failure')), {planted.DIGITS}))::BIGINT / {16**planted.DIGITS}.0 AS u FROM r),
p AS (SELECT 't-' || number AS trace_id, day_no, CASE WHEN day_no >= {planted.DRIFT_DAY} THEN {_case(2)} ELSE {_case(1)} END AS taxonomy_id FROM u)"""


def _traces(spark: SparkSession, d: str) -> DataFrame:
    day_no = (1 + F.col("o_orderkey") % 28).cast("long")
    ts = F.timestamp_seconds(1_785_542_400 + (day_no - 1) * 86_400 + F.col("o_orderkey") % 86_400)
    rows = table(spark, d, "orders").select(day_no.alias("day_no"), F.col("o_orderkey").cast("long").alias("number"), F.concat(F.lit("t-"), F.col("o_orderkey").cast("string")).alias("trace_id"), ts.alias("ts"))
    return planted.plant(rows, SEED)


@query(f"{PLANTED} SELECT trace_id, taxonomy_id, CASE WHEN taxonomy_id LIKE 'F-RET%' THEN 'retrieve' ELSE 'generate' END AS stage, day_no FROM p WHERE taxonomy_id IS NOT NULL")
def planted_truth(spark, d):
    return planted.truth(_traces(spark, d))


@query(f"{PLANTED} SELECT taxonomy_id AS truth, taxonomy_id AS found, count(*) AS n FROM p WHERE taxonomy_id IS NOT NULL GROUP BY taxonomy_id")
def planted_confusion(spark, d):
    """What the rules find against what was planted; the SQL has what was planted on both sides."""
    traces = keep(_traces(spark, d), "planted")
    return quality.confusion(classify.failures(traces), planted.truth(traces))


@query(f"{PLANTED} SELECT count(*) AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall FROM p WHERE taxonomy_id IS NOT NULL")
def planted_precision_recall(spark, d):
    traces = keep(_traces(spark, d), "planted")
    return quality.precision_recall(classify.failures(traces), planted.truth(traces))


@query(f"{PLANTED} SELECT taxonomy_id, count(*) AS n, true AS accurate FROM p WHERE taxonomy_id IS NOT NULL GROUP BY taxonomy_id")
def planted_blame(spark, d):
    """Whether the most suspicious stage is where the cause is, in nine of ten planted failures of each class."""
    traces = keep(_traces(spark, d), "planted")
    failures = keep(classify.failures(traces), "planted-failures")
    top = blame.top_stage(traces, failures, blame.baseline(traces, failures))
    return quality.blame_accuracy(top, planted.truth(traces)).withColumn("accurate", F.col("accurate") >= 0.9)


@query(f"{PLANTED} SELECT type, min(day_no) >= {planted.DRIFT_DAY} AS after_drift FROM p, (VALUES ('chi_square'), ('cusum')) AS t(type) WHERE taxonomy_id IS NOT NULL AND day_no >= {planted.DRIFT_DAY} GROUP BY type")
def planted_drift(spark, d):
    """Which detectors fire, and whether none does before the drift begins."""
    found = drift.alerts(classify.mix_per_day(classify.failures(keep(_traces(spark, d), "planted"))))
    return found.groupBy("type").agg((F.min("day") >= F.lit("2026-08-15").cast("date")).alias("after_drift"))
