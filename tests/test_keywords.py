from pyspark.sql import functions as F

from spanwright.operators import classify


def test_each_text_is_scored_once(spark):
    rows = spark.createDataFrame([(1, "TIMEOUT and timed out, tool"), (2, None), (3, "calm"), (4, "error errors cost")], "id long, text string")
    found = classify.keyword_verdicts(rows, "id", F.col("text"))
    plan = found.select("id", "v.taxonomy_id", "v.confidence")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count(", timed out, ") == 1
    got = {r.id: (r.v.taxonomy_id, float(r.v.confidence)) for r in found.collect()}
    assert got == {1: ("F-INFRA-001", 0.5), 4: ("F-TOOL-001", 0.5)}
