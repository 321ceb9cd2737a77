"""The published figures, on the planted corpus."""

import pytest
from pyspark.sql import functions as F

from spanwright.operators import blame, classify, cluster, drift, quality
from spanwright.sources import planted, records


@pytest.fixture(scope="module", params=[42, 7])
def corpus(spark, request):
    traces = planted.corpus(spark, request.param).persist()
    yield traces, planted.truth(traces).persist(), classify.failures(traces).persist()
    traces.unpersist()


def test_size_rates_and_shape(corpus):
    traces, truth, _ = corpus
    assert traces.count() == 560 and traces.select("trace_id").distinct().count() == 560
    rates = {r.late: r.n / (14 * 20) for r in truth.groupBy((F.col("day_no") >= 15).alias("late")).agg(F.count("*").alias("n")).collect()}
    assert abs(rates[False] - 0.42) < 0.09 and abs(rates[True] - 0.68) < 0.09
    assert {r.taxonomy_id for r in truth.select("taxonomy_id").distinct().collect()} == {n for n, _, _ in planted.PLAN}
    assert traces.where("spans[0].stage <> 'embed' or exists(spans, s -> s.pos is null)").count() == 0


def test_classes_are_recovered(corpus):
    _, truth, failures = corpus
    r = quality.precision_recall(failures, truth).first()
    assert r.precision == 1.0 and r.recall == 1.0 and r.tp == truth.count()


def test_blame_finds_the_stage(corpus):
    traces, truth, failures = corpus
    top = blame.top_stage(traces, failures, blame.baseline(traces, failures))
    rows = quality.blame_accuracy(top, truth).collect()
    assert sum(r.n * r.accurate for r in rows) / sum(r.n for r in rows) >= 0.95
    shares = {(r.taxonomy_id, r.stage): r.share for r in blame.cohort_shares(top).collect()}
    assert shares["F-RET-001", "retrieve"] >= 0.8 and shares["F-RET-002", "retrieve"] >= 0.8 and shares["F-INFRA-001", "generate"] >= 0.8


def test_families_are_recovered(corpus):
    _, truth, failures = corpus
    members = cluster.families(failures)
    cards = cluster.cards(members).collect()
    assert len(cards) >= 7
    pure = {r.dominant: max(x.purity for x in cards if x.dominant == r.dominant) for r in cards}
    assert all(pure.get(name, 0) >= 0.9 for name in {r.taxonomy_id for r in truth.collect()})


def test_classes_lie_apart(corpus):
    _, _, failures = corpus
    texts = cluster.evidence_text(failures)
    weights = cluster.tfidf(texts)
    terms = {r.term: k for k, r in enumerate(weights.select("term").distinct().orderBy("term").collect())}
    number = F.create_map(*(F.lit(x) for kv in terms.items() for x in kv))
    dense = weights.groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct(number[F.col("term")].alias("i"), "weight"))).alias("m"))
    vectors = dense.join(texts, "trace_id").select(F.col("taxonomy_id").alias("label"), F.transform(F.sequence(F.lit(0), F.lit(len(terms) - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("embedding"))
    r = cluster.pair_distances(vectors).first()
    assert r.inter - r.intra > 0.3


def test_drift_is_found_and_the_quiet_days_are_quiet(corpus):
    _, _, failures = corpus
    daily = classify.mix_per_day(failures)
    found = drift.alerts(daily).collect()
    chi = [r.day.isoformat() for r in found if r.type == "chi_square"]
    assert chi and min(chi) >= "2026-08-15"
    assert any(r.type == "cusum" and r.taxonomy_id for r in found)
    assert drift.alerts(daily.where("day < '2026-08-15'")).count() == 0


def test_same_traces_in_any_partitioning(spark):
    rows = planted.requests(spark, 5, 9)
    one, many = planted.plant(rows.coalesce(1), 3), planted.plant(rows.repartition(7, "trace_id").where("day_no <> 2"), 3)
    assert one.where("day_no <> 2").exceptAll(many).count() == 0 and many.count() == 36
    assert planted.plant(rows, 4).exceptAll(one).count() == 45


def test_lines_are_read_back(spark, tmp_path):
    traces = planted.corpus(spark, days=3, per_day=10)
    planted.write_lines(traces.coalesce(1), f"{tmp_path}/lines.jsonl")
    again = records.load(spark, f"{tmp_path}/lines.jsonl")
    assert again.select("trace_id", "ts", "total_cost", "spans").exceptAll(traces.select("trace_id", "ts", "total_cost", "spans")).count() == 0
    assert again.count() == 30
    with pytest.raises(ValueError):
        planted.corpus(spark, days=2)
