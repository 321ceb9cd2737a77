"""``python -m spanwright``: demo, ingest, analyze, report, watch, replay.

A source is a file of traces (``.jsonl``, ``.ndjson``, ``.json``), a folder or file of telemetry exports (``--exports``) or, with
``--store``, a store. Exit code 2: nothing could be read, or a setting does not fit.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import settings as settings_
from .keeping import keep
from .operators import blame, classify, cluster, drift, incident, quality, report, session, whatif
from .sources import artifacts, otlp, overrides, planted, records
from .sources.store import StoreError, open_store


def _source(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.store:
        return open_store(spark, args.store).traces
    if not args.source:
        raise records.IngestError("a source or --store is needed")
    if args.exports:
        texts = spark.read.text(args.source, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), "value")
        return otlp.parse(texts)
    return records.load(spark, args.source)


def _told(traces: DataFrame, s: settings_.Settings, title: str) -> tuple[str, DataFrame, DataFrame]:
    """The report's text, failures and alerts."""
    failures = keep(classify.failures(traces, s.limits()), "failures")
    alerts = keep(drift.alerts(classify.mix_per_day(failures), s.baseline_days, s.window_days, s.alpha, h=s.cusum_h), "alerts")
    top = keep(blame.top_stage(traces, failures, blame.baseline(traces, failures)), "top")
    members = keep(cluster.families(failures, s.cluster_cut, s.max_clusters), "families")
    return report.report(traces, failures, top, cluster.family_cards(failures, members), alerts, title=title), failures, alerts


def demo(spark: SparkSession, args: argparse.Namespace, s: settings_.Settings) -> None:
    traces = keep(planted.corpus(spark, args.seed, args.days, args.per_day), "planted")
    truth = planted.truth(traces)
    text, failures, alerts = _told(traces.drop("planted", "day_no"), s, "Failures of a planted corpus")
    artifacts.write_text(spark, text, f"{args.out}/report.md")
    artifacts.write_rows(failures, f"{args.out}/failures.jsonl")
    artifacts.write_rows(truth, f"{args.out}/truth.jsonl")
    artifacts.write_rows(alerts, f"{args.out}/alerts.jsonl")
    r = quality.precision_recall(failures, truth).first()
    print(f"{traces.count()} traces, {failures.count()} failures, precision {r.precision:.3f}, recall {r.recall:.3f}: {args.out}")


def ingest(spark: SparkSession, args: argparse.Namespace, s: settings_.Settings) -> None:
    traces = keep(_source(spark, argparse.Namespace(store=None, source=args.source, exports=args.exports)), "ingest")
    failures = keep(classify.failures(traces, s.limits()), "failures")
    store = open_store(spark, args.store)
    store.insert(traces, failures)
    print(f"{traces.count()} traces, {failures.count()} failures; {store.count_traces()} in {args.store}")


def analyze(spark: SparkSession, args: argparse.Namespace, s: settings_.Settings) -> None:
    mix = classify.mix(classify.failures(_source(spark, args), s.limits()))
    for r in artifacts.canonical(mix).orderBy("value").collect():  # a row for each class
        print(r.value)


def tell(spark: SparkSession, args: argparse.Namespace, s: settings_.Settings) -> None:
    text, failures, _ = _told(keep(_source(spark, args), "cohort"), s, "Failure report")
    if not args.out:
        print(text)
        return
    artifacts.write_text(spark, text, f"{args.out}/report.md")
    artifacts.write_rows(incident.tickets(failures, entries=overrides.entries(spark, args.overrides)), f"{args.out}/tickets.jsonl")


def watch(spark: SparkSession, args: argparse.Namespace, s: settings_.Settings) -> None:
    traces = keep(_source(spark, args), "cohort")
    daily = classify.mix_per_day(classify.failures(traces, s.limits()))
    for r in artifacts.canonical(drift.alerts(daily, s.baseline_days, s.window_days, s.alpha, h=s.cusum_h)).orderBy("value").collect():  # alerts by day
        print(r.value)


def replay(spark: SparkSession, args: argparse.Namespace, s: settings_.Settings) -> None:
    traces = keep(_source(spark, args), "cohort")
    one = open_store(spark, args.store).get(args.trace) if args.store else traces.where(F.col("trace_id") == args.trace)
    if one.isEmpty():
        raise records.IngestError(f"there is no trace {args.trace}")
    if args.what_if:
        for r in artifacts.canonical(whatif.attempts(one, classify.cost_limit(traces, s.cost_factor), limits=s.limits()).drop("number")).orderBy("value").collect():  # a row for each mutation
            print(r.value)
    elif args.json:
        print(session.as_json(one, args.at).first().value)
    else:
        print(session.as_text(one, args.at).first().text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanwright", description=__doc__)
    top.add_argument("--settings", help="a file of NAME=value lines")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *, source: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        if source:
            p.add_argument("source", nargs="?")
            p.add_argument("--exports", action="store_true", help="the source holds telemetry exports")
        return p

    p = command("demo", demo, source=False)
    for name, kind, value in (("--seed", int, 42), ("--days", int, 28), ("--per-day", int, 20)):
        p.add_argument(name, type=kind, default=value)
    p.add_argument("--out", required=True)
    command("ingest", ingest).add_argument("--store", required=True)
    for name, run in (("analyze", analyze), ("watch", watch)):
        command(name, run).add_argument("--store")
    p = command("report", tell)
    for name in ("--store", "--out", "--overrides"):
        p.add_argument(name)
    p = command("replay", replay)
    p.add_argument("--store")
    p.add_argument("--trace", required=True)
    p.add_argument("--at", type=int)
    p.add_argument("--json", action="store_true")
    p.add_argument("--what-if", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        s = settings_.load(file=args.settings)
        args.run(spark or SparkSession.builder.appName("spanwright").config("spark.sql.session.timeZone", "UTC").getOrCreate(), args, s)
    except (records.IngestError, StoreError, overrides.OverrideError, settings_.SettingsError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        print(f"there is no {args.source}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
