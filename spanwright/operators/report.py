"""The report on a cohort: small sorted aggregates, made on Spark and put together as Markdown.

What comes to the driver has a row for each class, stage, day or cluster, whatever the cohort's size. Read ``traces``
and ``failures`` from tables: each section is a job over them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PLAYBOOKS, STAGES, TAXONOMY
from . import blame, health

#: Days of one section of the timeline, and causes that are told in full.
DAYS, CAUSES = 7, 3


def header(traces: DataFrame) -> DataFrame:
    """One row: n traces, their pipelines (sorted), first and last time."""
    return traces.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("pipeline_name")).alias("pipelines"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def classes(failures: DataFrame) -> DataFrame:
    """taxonomy_id, n, share, sample (the failure with the smallest trace_id), in the order of the mix: largest first, then by id."""
    sample = F.struct("trace_id", "confidence", F.slice("evidence", 1, 3).alias("evidence"))
    counts = failures.groupBy("taxonomy_id").agg(F.count("*").alias("n"), F.min_by(sample, "trace_id").alias("sample"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).orderBy(F.desc("n"), "taxonomy_id")  # a row for each class


def sample_traces(traces: DataFrame, found: DataFrame) -> DataFrame:
    """taxonomy_id and the trace of each sample of ``classes``; samples whose trace is not there are left out."""
    of = found.select("taxonomy_id", F.col("sample.trace_id").alias("trace_id"))  # a row for each class
    return traces.join(F.broadcast(of), "trace_id")


def timeline(failures: DataFrame) -> DataFrame:
    """day, taxonomy_id, n, in that order."""
    return failures.groupBy("day", "taxonomy_id").agg(F.count("*").alias("n")).orderBy("day", "taxonomy_id")


def _dominant(found: list) -> object | None:
    """The most frequent class; of equally frequent ones that of the smallest trace_id."""
    return min(found, key=lambda r: (-r.n, r.sample.trace_id), default=None)


def _rank(stage: str) -> int:
    return STAGES.index(stage) if stage in STAGES else len(STAGES)


def report(
    traces: DataFrame, failures: DataFrame, top: DataFrame | None = None, clusters: DataFrame | None = None, alerts: DataFrame | None = None,
    titles: Mapping[str, str] | None = None, playbooks: Mapping[str, str] | None = None, title: str = "Failure report",
) -> str:
    """Markdown on a cohort.

    ``top``: ``blame.top_stage``; ``clusters``: ``cluster.family_cards``; ``alerts``: ``drift.alerts``; a part that is
    not given is left out (clusters, drift) or empty (blame). Equal input gives an equal text; an empty cohort gives
    a report without failures.
    """
    names = {k: v[0] for k, v in TAXONOMY.items()} | dict(titles or {})
    fixes = PLAYBOOKS | dict(playbooks or {})
    name = lambda c: names.get(c, c)
    head, found, cards = header(traces).head(), classes(failures).collect(), health.report_cards(traces).collect()
    shares = blame.cohort_shares(top).collect() if top is not None else []
    shares = sorted(shares, key=lambda r: (r.taxonomy_id, -r.share, _rank(r.stage)))
    fired = sorted(alerts.collect(), key=lambda r: (r.type != "chi_square", r.day, r.type, r.taxonomy_id or "")) if alerts is not None else []
    total = sum(r.n for r in found)
    out = [f"# {title}", ""]
    if head.n:
        out += [f"*{', '.join(head.pipelines)}, {head.first.isoformat()} to {head.last.isoformat()}, {head.n} traces*", ""]

    most = _dominant(found)
    out += ["## Summary", "", f"- {total} of {head.n} traces failed ({total / max(head.n, 1):.1%})."]
    if most is not None:
        blamed = next((r.stage for r in shares if r.taxonomy_id == most.taxonomy_id), None)
        out.append(f"- Most frequent: **{most.taxonomy_id} {name(most.taxonomy_id)}** ({most.n} traces, {most.n / total:.0%})" + (f", blamed on **{blamed}**." if blamed else "."))
    ill = {s: [c.stage for c in cards if c.status == s] for s in ("crit", "warn")}
    out.append("- Stages: " + ("; ".join(f"{s} {', '.join(x)}" for s, x in ill.items() if x) or "all within their limits") + ".")
    out += [f"- Drift: {fired[0].type} on {fired[0].day}." if fired else "- Drift: none found.", ""]

    out += ["## Failure mix", "", "| class | failure | stage | traces | share |", "|---|---|---|---:|---:|"]
    out += [f"| {r.taxonomy_id} | {name(r.taxonomy_id)} | {TAXONOMY.get(r.taxonomy_id, ('', '?'))[1]} | {r.n} | {r.share:.1%} |" for r in found]
    out += ["", "## Root causes", ""]
    for r in found[:CAUSES]:
        out += [f"### {r.taxonomy_id} {name(r.taxonomy_id)} ({r.n} traces)", ""]
        of_class = [s for s in shares if s.taxonomy_id == r.taxonomy_id]
        if of_class:
            out += ["Blame: " + ", ".join(f"{s.stage} {s.share:.0%}" for s in of_class), ""]
        out.append(f"Seen in `{r.sample.trace_id}` (confidence {r.sample.confidence:.2f}):")
        out += ["", *(f"- `{e.span_id}` `{e.key}={e.value}`" + (f" ({e.note})" if e.note else "") for e in r.sample.evidence or []), ""]

    every = {r.stage: r.share for r in blame.weighted_shares(top).collect()} if top is not None else {}
    stages = sorted((s for s in every if every[s] > 0), key=_rank)
    out += ["## Blame", "", "```mermaid", "graph TD", *(f'    S{k}["{s}: {every[s]:.0%}"]' for k, s in enumerate(stages))]
    out += [*(f"    S{k} --> S{k + 1}" for k in range(len(stages) - 1)), "```", "", "## Timeline", "", "```mermaid", "timeline", "    title Failures by day"]
    by_day: dict = {}
    for r in timeline(failures).collect():
        by_day.setdefault(r.day, []).append(f"{r.taxonomy_id} x{r.n}")
    for k, (day, events) in enumerate(by_day.items()):
        if k % DAYS == 0:
            out.append(f"    section Days {k + 1} to {min(k + DAYS, len(by_day))}")
        out.append(f"        {day} : {' : '.join(events)}")
    out += [*(["        No failures"] if not by_day else []), "```", "", "## Stages", ""]
    out += [f"- **{c.stage}** [{c.status}]: " + ", ".join(f"{k}={v}" for k, v in sorted((c.metrics or {}).items())) + (f" ({'; '.join(c.flags)})" if c.flags else "") for c in cards]
    if clusters is not None:
        out += ["", "## Families", ""]
        out += [f"- **#{c.cluster}** {c.size} failures ({c.share:.0%}), {', '.join(c.terms) or '-'}; mostly {c.dominant} ({c.purity:.0%}), as in `{c.representative}`" for c in sorted(clusters.collect(), key=lambda c: c.cluster)]
    if alerts is not None:
        out += ["", "## Drift", "", *(["| type | day | class | statistic |", "|---|---|---|---:|"] if fired else ["No alerts."])]
        out += [f"| {a.type} | {a.day} | {a.taxonomy_id or 'all'} | {a.statistic:.4f} |" for a in fired]
    out += ["", "## Fixes", "", *(f"- **{c}** {name(c)}: {fixes.get(c, 'no fix is known yet')}" for c in sorted(r.taxonomy_id for r in found)), ""]
    return "\n".join(out)
