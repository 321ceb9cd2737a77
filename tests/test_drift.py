from spanwright.operators import classify, drift
from spanwright.sources import planted


def test_alerts_count_the_failures_once(spark):
    """The counts by day are kept: what the detectors read does not hold the plan of the failures."""
    daily = classify.mix_per_day(classify.failures(planted.corpus(spark, days=20, per_day=5)))
    plan = drift.alerts(daily)._jdf.queryExecution().optimizedPlan().toString()
    assert "json_error" not in plan
