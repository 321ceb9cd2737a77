import datetime as dt
import json
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from spanwright.operators import classify, drift
from spanwright.streaming import assembly, intake, watch

DAY = dt.date(2026, 3, 1)


def export(path, *spans):
    path.write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": list(spans)}]}]}))


def span(n, **more):
    return {"traceId": "ab" * 16, "spanId": f"{n:016x}", "startTimeUnixNano": str(1_700_000_000_000_000_000 + n)} | more


@pytest.fixture
def box(spark, tmp_path):
    """A folder of exports with what was made of them."""

    class Box:
        folder, out = tmp_path / "in", str(tmp_path / "out")

        def put(self, name, *spans):
            self.folder.mkdir(exist_ok=True)
            export(self.folder / name, *spans)

        def run(self, **source):
            intake.intake(spark, str(self.folder), self.out, str(tmp_path / "cp"), **source).awaitTermination()

        def spans(self):
            return sorted(int(r.span_id, 16) for r in intake.spans(spark, self.out).collect())

        def assemble(self, quiet_s=0.0):
            assembly.assemble(spark, self.out, str(tmp_path / "cpa"), quiet_s).awaitTermination()
            return {r.trace_id[:2]: r for r in assembly.traces(spark, self.out).collect()}

    return Box()


def test_intake_keeps_each_span_once_and_goes_on(spark, box):
    box.put("a.json", span(1), span(2), {"name": "lost"})
    box.put("b.json", span(2), span(3))
    box.run()
    box.put("c.json", span(3), span(4))
    box.run()
    assert box.spans() == [1, 2, 3, 4]
    assert [(r.level, r.reason) for r in intake.skipped(spark, box.out).collect()] == [("span", "missing or unreadable traceId")]


def test_intake_keeps_late_and_undated_spans(spark, box):
    day = 86_400_000_000_000
    undated = span(4)
    del undated["startTimeUnixNano"]
    box.put("a.json", span(1), span(2, startTimeUnixNano=str(1_700_000_000_000_000_000 - day)))
    box.run()
    box.put("b.json", span(3, startTimeUnixNano=str(1_700_000_000_000_000_000 - day)), undated)
    box.run()
    box.put("c.json", span(5, startTimeUnixNano=None), span(6), span(7), span(2))
    box.run()
    assert box.spans() == [1, 2, 3, 4, 5, 6, 7]
    found = {r.batch: (r.spans, r.undated, r.late, r.skipped) for r in intake.counts(spark, box.out).collect()}
    assert sorted(found.values()) == [(2, 0, 0, 0), (2, 1, 1, 0), (3, 1, 0, 0)]


def test_exports_newest_first_one_a_batch(spark, box):
    for k in range(6):
        box.put(f"{k}.json", span(k, startTimeUnixNano=str(1_700_000_000_000_000_000 - k * 86_400_000_000_000)))
    box.run(files=1)
    assert box.spans() == list(range(6))


def test_archived_files_are_skipped_in_the_same_commit(spark, box, tmp_path):
    for k in range(4):
        box.put(f"{k}.json", span(k), {"name": f"bad {k}"})
        box.run(files=1, archive=str(tmp_path / "old"))
    assert box.spans() == [0, 1, 2, 3] and intake.skipped(spark, box.out).count() == 4


def test_a_batch_that_fails_halfway_is_written_once(spark, box, tmp_path, monkeypatch):
    box.put("a.json", span(1), span(2))
    whole = DataFrameWriter.parquet

    def broken(self, path, *a, **b):
        whole(self, path, *a, **b)
        raise OSError("lost after writing")

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", broken)
        with pytest.raises(Exception, match="lost after writing"):
            box.run()
    box.run()
    box.put("b.json", span(2), span(3))
    box.run()
    assert box.spans() == [1, 2, 3]


def test_a_trace_over_several_exports_and_runs_is_one(spark, box):
    a, b = {"traceId": "aa" * 16}, {"traceId": "bb" * 16}
    box.put("a.json", span(1, **a), span(2, **b))
    box.put("b.json", span(3, **a))
    box.run()
    found = box.assemble()
    assert {k: (r.revision, r.n_spans, r.late_spans) for k, r in found.items()} == {"aa": (1, 2, 0), "bb": (1, 1, 0)}
    box.put("c.json", span(0, **a), span(3, **a))
    box.run()
    found = box.assemble()
    assert (found["aa"].revision, found["aa"].n_spans, found["aa"].late_spans, found["bb"].revision) == (2, 3, 1, 1)
    assert [int(s.span_id, 16) for s in found["aa"].spans] == [0, 1, 3] and [s.pos for s in found["aa"].spans] == [0, 1, 2]


def test_a_trace_waits_until_nothing_more_comes(spark, box):
    box.put("a.json", span(1))
    box.run()
    assert box.assemble(quiet_s=3600) == {}
    box.put("b.json", span(2))
    box.run()
    assert box.assemble(quiet_s=3600) == {}
    states = box.assemble(quiet_s=0)  # nothing new: nothing is due
    assert states == {}


def test_windows_of_failures(spark, tmp_path):
    rows = [(dt.datetime(2026, 3, d, 12), c) for d, c in ((1, "A"), (1, "A"), (2, "B"), (3, "A"), (9, "A"))]
    spark.createDataFrame(rows, "ts timestamp, taxonomy_id string").coalesce(1).write.parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema("ts timestamp, taxonomy_id string").parquet(str(tmp_path / "f"))
    intake.available_now(intake.mix_by_window(stream), str(tmp_path / "d"), str(tmp_path / "cd")).awaitTermination()
    assert sorted((r.start.day, r.taxonomy_id, r.n) for r in spark.read.parquet(str(tmp_path / "d")).collect()) == [(1, "A", 2), (2, "B", 1), (3, "A", 1)]
    intake.available_now(intake.mix_by_window(stream, "3 days", "1 day"), str(tmp_path / "s"), str(tmp_path / "cs")).awaitTermination()
    got = {(r.start.month, r.start.day, r.taxonomy_id): r.n for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    assert got[3, 1, "A"] == 3 and got[2, 27, "A"] == 2 and got[3, 3, "A"] == 1 and got[2, 28, "B"] == 1


def daily_alerts(rows, days, **more):
    """(type, day, class, statistic) by the batch operators."""
    found = drift.alerts(classify.mix_per_day(rows), days=days, **more).collect()
    return sorted((r.type, r.day, r.taxonomy_id or "", round(r.statistic, 6)) for r in found)


@pytest.mark.parametrize("two_cell", [False, True])
def test_watch_gives_the_alerts_of_the_batch_across_restarts(spark, tmp_path, two_cell):
    rng = random.Random(11)
    rows = []
    for d in range(34):
        late = d >= 18
        for name, mean in (("A", 9 if late else 4), ("B", 5), ("C", 0 if late else 3), ("D", 12 if late else 1), ("E", late)):
            rows += [("p", DAY + dt.timedelta(d), name)] * (0 if d in (6, 21) else max(0, round(rng.gauss(mean, 1.3))))
        rows.append(("p", DAY + dt.timedelta(d), None))  # a healthy request each day
    table = spark.createDataFrame(rows, "pipeline_name string, day date, taxonomy_id string").withColumn("ts", F.col("day").cast("timestamp") + F.expr("INTERVAL 5 HOURS"))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((0, 9), (9, 16), (16, 27), (27, 34)):
        part = table.where(F.col("day").between(F.lit(DAY + dt.timedelta(low)), F.lit(DAY + dt.timedelta(high - 1))))
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(table.schema).parquet(folder)
        query = intake.available_now(watch.alerts(stream, watch.Limits(two_cell=two_cell)), out, str(tmp_path / "cp"))
        query.awaitTermination()
        assert watch.late_rows(query) == 0
    got = sorted((r.type, r.day, r.taxonomy_id or "", round(r.statistic, 6)) for r in spark.read.parquet(out).collect())
    # the last day is still open
    seen = table.where(F.col("day") < F.lit(DAY + dt.timedelta(33)))
    want = daily_alerts(seen.where("taxonomy_id is not null"), seen, two_cell=two_cell)
    assert got == want and {t for t, *_ in got} == {"chi_square", "cusum"}
    lines = [r.value for r in watch.as_lines(spark.read.parquet(out)).collect()]
    assert all(list(json.loads(x)) == sorted(json.loads(x)) for x in lines)
