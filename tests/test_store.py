import datetime as dt

import pytest
from pyspark.sql import functions as F

from spanwright.operators import classify
from spanwright.sources import files, planted
from spanwright.sources.store import LinesStore, ParquetStore, StoreError, open_store

TIME = dt.datetime(2026, 8, 2, 6, tzinfo=dt.UTC)


@pytest.fixture(scope="module")
def cohort(spark):
    traces = planted.corpus(spark, days=4, per_day=12).drop("planted", "day_no").persist()
    return traces, classify.failures(traces).persist()


@pytest.fixture(params=[ParquetStore, LinesStore])
def store(spark, tmp_path, request):
    return request.param(spark, str(tmp_path / "store"))


def rows(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=str)


def test_what_goes_in_comes_out(store, cohort):
    traces, failures = cohort
    assert store.count_traces() == 0 and store.failures.count() == 0 and store.get("t-001-000000").count() == 0
    store.insert(traces.where("day < '2026-08-03'"), failures.where("day < '2026-08-03'"))
    store.insert(traces.where("day >= '2026-08-03'"), failures.where("day >= '2026-08-03'"))
    assert store.count_traces() == 48
    assert rows(store.traces.select(*traces.columns)) == rows(traces) and rows(store.failures) == rows(failures)
    assert rows(store.failure_mix_per_day()) == rows(classify.mix_per_day(failures))


def test_looking_up(store, cohort):
    traces, failures = cohort
    store.insert(traces, failures)
    one = traces.where("trace_id = 't-002-000005'").first()
    assert store.get("t-002-000005").first().spans == one.spans
    assert [s.span_id for s in store.spans_by_trace("t-002-000005").collect()] == [s.span_id for s in one.spans]
    assert store.get("nobody").count() == 0 and store.spans_by_trace("nobody").count() == 0
    found = [r.trace_id for r in store.by_time(TIME, TIME + dt.timedelta(hours=5)).collect()]
    assert found == [r.trace_id for r in traces.where(F.col("ts").between(F.lit(TIME), F.lit(TIME + dt.timedelta(hours=5)))).orderBy("ts").collect()] and len(found) > 3


def changed(traces):
    """Some traces on another day, without their last span."""
    return traces.where("trace_id like '%-00000_' and day = '2026-08-01'").select("trace_id", "ts", F.lit("2026-08-09").cast("date").alias("day"), "pipeline_name", (F.col("total_cost") + 5).alias("total_cost"), F.slice("spans", 1, 1).alias("spans"))


def test_a_batch_replaces_its_traces_in_all_tables(spark, tmp_path, cohort):
    traces, failures = cohort
    store = ParquetStore(spark, str(tmp_path))
    store.insert(traces, failures)
    new = changed(traces)
    store.insert(new, failures.limit(0))
    old = traces.join(new, "trace_id", "left_anti")
    assert rows(store.traces.drop("meta")) == rows(old.unionByName(new))
    assert rows(store.failures) == rows(failures.join(new, "trace_id", "left_anti"))
    assert store.spans_by_trace("t-001-000003").count() == 1 and store.get("t-001-000003").first().total_cost > 5
    assert rows(store.at(1).traces.drop("meta")) == rows(traces)
    before = rows(store.traces), rows(store.failures), rows(store.spans)
    store.compact()
    assert (rows(store.traces), rows(store.failures), rows(store.spans)) == before and store.versions() == [1, 2, 3]
    store.vacuum()
    assert (rows(store.traces), rows(store.failures), rows(store.spans)) == before and store.versions() == [3]
    with pytest.raises(StoreError):
        store.at(1).count_traces()


def test_repeats_within_a_batch_and_meta(spark, tmp_path, cohort):
    traces, failures = cohort
    store = ParquetStore(spark, str(tmp_path))
    few = traces.limit(3).withColumn("meta", F.struct(F.lit("x").alias("env")))
    store.insert(few.unionByName(few), failures.limit(0))
    assert store.count_traces() == 3 and store.spans.count() == few.select(F.explode("spans")).count()
    assert {r.meta for r in store.traces.collect()} == {'{"env":"x"}'}


def test_a_writer_that_dies_between_tables_leaves_the_last_version(spark, tmp_path, cohort, monkeypatch):
    traces, failures = cohort
    store = ParquetStore(spark, str(tmp_path))
    store.insert(traces.where("day = '2026-08-01'"), failures.where("day = '2026-08-01'"))
    whole = ParquetStore._write

    def dies(self, folder, **tables):
        whole(self, folder, traces=tables["traces"], spans=tables["spans"])
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(ParquetStore, "_write", dies)
        with pytest.raises(OSError):
            store.insert(traces, failures)
    assert store.count_traces() == 12 and store.versions() == [1]
    assert rows(store.traces.drop("meta")) == rows(traces.where("day = '2026-08-01'"))
    store.insert(traces, failures)
    assert store.count_traces() == 48


def test_two_writers_give_two_versions(spark, tmp_path, cohort, monkeypatch):
    traces, failures = cohort
    one, two = (ParquetStore(spark, str(tmp_path)) for _ in range(2))
    create, raced = files.create, []

    def slow(spark, path, text):
        if not raced:
            raced.append(path)
            two.insert(traces.where("day = '2026-08-02'"), failures.where("day = '2026-08-02'"))  # comes in between
        return create(spark, path, text)

    monkeypatch.setattr(files, "create", slow)
    one.insert(traces.where("day = '2026-08-01'"), failures.where("day = '2026-08-01'"))
    assert one.versions() == [1, 2] and one.count_traces() == 24
    assert not create(spark, f"{tmp_path}/_versions/{2:012d}.json", "[]")


def files_read(spark, df):
    """How many files the scans of a query opened."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        leaves, found = df._jdf.queryExecution().executedPlan().collectLeaves().iterator(), 0
        while leaves.hasNext():
            found += leaves.next().metrics().get("numFiles").get().value()
        return found
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_look_up_opens_one_bucket_and_a_range_its_days(spark, tmp_path, cohort):
    traces, failures = cohort
    store = ParquetStore(spark, str(tmp_path), buckets=8)
    store.insert(traces, failures)
    spans, headers = (store._table(n, store._manifest()[1]) for n in ("spans", "traces"))
    everything = len(spans.inputFiles())
    found = files_read(spark, store.spans_by_trace("t-002-000005"))
    assert 0 < found <= 4 < everything / 4  # one bucket of four days
    assert files_read(spark, store.get("t-002-000005")) <= 8
    one_day = sum("day=2026-08-02" in f for f in spans.inputFiles() + headers.inputFiles())
    assert files_read(spark, store.by_time(TIME, TIME + dt.timedelta(hours=3))) == one_day


def test_torn_lines_are_errors(spark, tmp_path, cohort):
    traces, failures = cohort
    store = LinesStore(spark, str(tmp_path))
    store.insert(traces.limit(2), failures.limit(0))
    (tmp_path / "traces" / "part-torn.txt").write_text('{"trace_id": "x", "spans": [\n')
    with pytest.raises(Exception, match="cannot read in part-torn.txt"):
        store.traces.collect()


def test_repeated_lines_count_once(spark, tmp_path, cohort):
    traces, failures = cohort
    store = LinesStore(spark, str(tmp_path))
    for _ in range(2):
        store.insert(traces.limit(5), failures.limit(0))
    assert store.count_traces() == 5


def test_a_store_is_chosen_by_its_path(spark, tmp_path, cohort):
    assert isinstance(open_store(spark, f"{tmp_path}/a.lines"), LinesStore) and isinstance(open_store(spark, f"{tmp_path}/b"), ParquetStore)
    LinesStore(spark, f"{tmp_path}/c").insert(*(x.limit(1) for x in cohort))
    assert isinstance(open_store(spark, f"{tmp_path}/c"), LinesStore)
