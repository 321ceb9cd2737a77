"""Drift of the failure mix, watched as requests come in: the same alerts as ``drift.alerts`` over the same days.

State is kept for each pipeline: counts of open days, the baseline's sums, the last ``window_days`` days, the flags since the last
chi-square alert and a sum for each class. A day is closed by a timer when the watermark passes its end; so classes that are quiet get
their zero without a row of their own, and rows of healthy requests (no class) are what keeps the days of a quiet pipeline.
What is later than ``late`` is not watched (``late_rows`` says how much that is); it is in the batch tables all the same.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.stats import upper_gamma
from .assembly import with_rocks

ALERTS = "pipeline_name string, type string, day date, taxonomy_id string, statistic double"
_DAY_MS = 86_400_000


@dataclass(frozen=True)
class Limits:
    baseline_days: int = 14
    window_days: int = 3
    alpha: float = 0.01
    two_cell: bool = False
    k: float = 0.5
    h: float = 5.0
    lookback: int = 3
    least: int = 2


def chi_square(share: dict[str, float], observed: dict[str, int], two_cell: bool = False) -> tuple[float, int]:
    """Statistic and degrees of freedom of counts against a mix; classes expected below 5 times are one cell if two others are left."""
    total = sum(observed.values())
    expected = {c: s * total for c, s in share.items()}
    large = sum(e >= 5 for e in expected.values())
    cells: dict[str, list[float]] = {}
    for c, e in expected.items():
        cell = cells.setdefault("other" if e < 5 and large >= 2 else "all" if two_cell else c, [0.0, 0.0])
        cell[0] += observed.get(c, 0)
        cell[1] += e
    kept = [(o, e) for o, e in cells.values() if e > 0]
    return sum((o - e) ** 2 / e for o, e in kept), len(kept) - 1


class Days(StatefulProcessor):
    """One pipeline's days, closed in order; yields rows of ``ALERTS``."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "day int, taxonomy_id string", "n long")  # "" counts all requests
        self.base = handle.getMapState("base", "taxonomy_id string", "total long, squares long")
        self.sums = handle.getMapState("sums", "taxonomy_id string", "s double")
        self.closed = handle.getValueState("closed", "days int")
        self.window = handle.getListState("window", "day int, taxonomy_id string, n long")
        self.flags = handle.getListState("flags", "flag boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found: dict[tuple[int, str], int] = {}
        for batch in rows:
            days = batch["ts"].map(lambda t: t.toordinal())
            for (day, name), n in batch.groupby([days, batch["taxonomy_id"].fillna("")]).size().items():
                found[int(day), name] = found.get((int(day), name), 0) + int(n)
                found.setdefault((int(day), ""), 0)
        for at, n in found.items():
            old = self.open.getValue(at)[0] if self.open.containsKey(at) else 0
            self.open.updateValue(at, (old + n,))
        for day in {d for d, _ in found}:
            end = dt.datetime.combine(dt.date.fromordinal(day + 1), dt.time(), dt.UTC)
            self.handle.registerTimer(int(end.timestamp() * 1000))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last = dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, dt.UTC).date().toordinal() - 1
        waiting: dict[int, dict[str, int]] = {}
        for (day, name), (n,) in list(self.open.iterator()):
            if day <= last:
                waiting.setdefault(day, {})[name] = n
        out = [(key[0], *alert) for day in sorted(waiting) for alert in self._close(day, waiting[day])]
        for day, names in waiting.items():
            for name in names:
                self.open.removeKey((day, name))
        if out:
            yield pd.DataFrame(out, columns=["pipeline_name", "type", "day", "taxonomy_id", "statistic"])

    def _close(self, day: int, counts: dict[str, int]) -> Iterator[tuple[str, dt.date, str | None, float]]:
        x, date = self.limits, dt.date.fromordinal(day)
        counts = {name: n for name, n in counts.items() if name}
        number = (self.closed.get()[0] if self.closed.exists() else 0) + 1
        self.closed.update((number,))
        if number <= x.baseline_days:
            for name, n in counts.items():
                total, squares = self.base.getValue((name,)) if self.base.containsKey((name,)) else (0, 0)
                self.base.updateValue((name,), (total + n, squares + n * n))
            return
        base = {name: pair for (name,), pair in self.base.iterator()}
        # the last days, this one included
        kept = [r for r in self.window.get() if r[0] in self._last(day)] if self.window.exists() else []
        kept += [(day, name, n) for name, n in counts.items()] or [(day, "", 0)]
        self.window.put([tuple(r) for r in kept])
        if number >= x.baseline_days + x.window_days:
            total = sum(t for t, _ in base.values())
            observed: dict[str, int] = {}
            for _, name, n in kept:
                observed[name] = observed.get(name, 0) + n
            share = {name: t / total for name, (t, _) in base.items()} if total else {}
            stat, df = chi_square(share | {name: 0.0 for name in observed if name and name not in share}, observed, x.two_cell) if share else (0.0, 0)
            flag = df > 0 and upper_gamma(df / 2, stat / 2) < x.alpha
            flags = ([f for (f,) in self.flags.get()] if self.flags.exists() else [])[-(x.lookback - 1) :] + [flag]
            alert = flag and sum(flags) >= x.least
            self.flags.put([(f,) for f in flags]) if not alert else self.flags.clear()
            if alert:
                yield "chi_square", date, None, stat
        for name, (total, squares) in sorted(base.items()):
            mean = total / x.baseline_days
            std = math.sqrt(max(0.0, squares / x.baseline_days - mean * mean))
            if not (mean > 0 and std > 1e-9):
                continue
            s = self.sums.getValue((name,))[0] if self.sums.containsKey((name,)) else 0.0
            s = max(0.0, s + (counts.get(name, 0) - mean) / std - x.k)
            self.sums.updateValue((name,), (0.0 if s > x.h else s,))
            if s > x.h:
                yield "cusum", date, name, s

    def _last(self, day: int) -> set[int]:
        """The days of the window before ``day``: the last ones that were closed."""
        days = sorted({r[0] for r in self.window.get()})
        return set(days[-(self.limits.window_days - 1) :]) if self.limits.window_days > 1 else set()

    def close(self) -> None:
        pass


def alerts(requests: DataFrame, limits: Limits = Limits(), late: str = "1 hour") -> DataFrame:
    """A stream of ``ALERTS`` from a stream of requests (pipeline_name, ts, taxonomy_id or null)."""
    with_rocks(requests.sparkSession)
    timed = requests.select("pipeline_name", "ts", "taxonomy_id").withWatermark("ts", late)
    return timed.groupBy("pipeline_name").transformWithStateInPandas(Days(limits), outputStructType=ALERTS, outputMode="append", timeMode="EventTime")


def as_lines(alerts: DataFrame) -> DataFrame:
    """value: each alert as JSON with its keys in order, without those that are null."""
    return alerts.select(F.to_json(F.struct(*sorted(alerts.columns))).alias("value"))


def late_rows(query: StreamingQuery) -> int:
    """Rows of all micro-batches of a query's run that came after the watermark."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
