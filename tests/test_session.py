import json

import pytest
from pyspark.sql import functions as F

from spanwright.operators import session
from spanwright.schema import TRACES


def span(k, stage, status="ok", ms=1.5, tokens=(0, 0), cost=0.0, **attrs):
    return {"pos": k, "span_id": f"s{k}", "name": stage, "stage": stage, "duration_ms": ms, "status": status, "tokens_in": tokens[0], "tokens_out": tokens[1], "cost": cost, "attrs": attrs}


@pytest.fixture(scope="module")
def traces(spark):
    rows = {
        "full": [
            span(0, "embed", model="m-small", token_count=7.0), span(1, "retrieve", ms=20.25, model="m-small", query='deep "pool"?', top_k=3, hit_count=2, hit_scores=[0.75, 0.5]),
            span(2, "tool", status="error", error="not there", hit_count=0), span(3, "generate", ms=812.0, tokens=(900, 120), cost=0.0042, query='deep "pool"?', output="two\nlines", finish_reason="stop"), span(4, "generate", tokens=(10, 1), cost=0.001, model="m-large"),
        ],
        "empty": [],
    }
    made = [(json.dumps({"trace_id": k, "ts": "2026-05-04T03:02:01Z", "day": "2026-05-04", "pipeline_name": "p", "total_cost": 0.0, "spans": v}),) for k, v in rows.items()]
    return spark.createDataFrame(made, "j string").select(F.from_json("j", TRACES).alias("t")).select("t.*")


def test_steps_hold_what_is_new(traces):
    rows = session.steps(traces).orderBy("step").collect()
    assert [(r.step, r.stage, r.status) for r in rows] == [(1, "embed", "ok"), (2, "retrieve", "ok"), (3, "tool", "error"), (4, "generate", "ok"), (5, "generate", "ok")]
    assert [set(r.delta) for r in rows] == [{"model", "token_count"}, {"query", "top_k", "hit_count", "hit_scores"}, {"error", "hit_count"}, {"output", "finish_reason"}, {"model"}]
    assert {k: json.loads(v) for k, v in rows[1].delta.items()} == {"query": 'deep "pool"?', "top_k": 3, "hit_count": 2, "hit_scores": [0.75, 0.5]}
    assert rows[2].delta["hit_count"] == "0"
    assert [(r.tokens_in, r.tokens_out, round(r.cost, 6)) for r in rows] == [(0, 0, 0), (0, 0, 0), (0, 0, 0), (900, 120, 0.0042), (910, 121, 0.0052)]


@pytest.mark.parametrize("at, step, stages", [(2, 2, ["embed", "retrieve"]), (0, 0, []), (-3, 0, []), (99, 5, ["embed", "generate", "retrieve", "tool"])])
def test_state_within_bounds(traces, at, step, stages):
    r = {r.trace_id: r for r in session.state_at(traces, at).collect()}
    assert (r["full"].step, r["full"].stages) == (step, stages) and (r["empty"].step, r["empty"].state) == (0, {})


def test_the_last_value_stands(traces):
    at = lambda n: session.state_at(traces.where("trace_id = 'full'"), n).first()
    assert at(2).state["hit_count"] == "2" and at(3).state["hit_count"] == "0" and at(5).state["model"] == '"m-large"'
    assert "output" not in at(3).state and (at(5).tokens_in, at(5).cost) == (910, 0.0052)


def test_as_text(traces):
    text = {r.trace_id: r.text.split("\n") for r in session.as_text(traces, at=3).collect()}
    full = text["full"]
    assert full[0] == "trace full of p at 2026-05-04T03:02:01Z"
    assert full[1] == '   1  embed     ok              1.5 ms  model="m-small" token_count=7.0'
    assert full[6] == "sums: tokens in 910, out 121, cost 0.0052"
    assert full[7] == "after step 3: embed, retrieve, tool" and full[8] == '  error = "not there"' and full[-1] == "  tokens in 0, out 0, cost 0.0000"
    assert text["empty"] == ["trace empty of p at 2026-05-04T03:02:01Z", "no spans", "after step 0: ", "  tokens in 0, out 0, cost 0.0000"]
    assert len(session.as_text(traces).where("trace_id = 'full'").first().text.split("\n")) == 7


def test_as_json(traces):
    found = {r.trace_id: r.value for r in session.as_json(traces, at=2).collect()}
    full = json.loads(found["full"])
    assert list(full) == sorted(full) and list(full["steps"][0]) == sorted(full["steps"][0])
    assert full["steps"][3]["delta"] == {"output": "two\nlines", "finish_reason": "stop"} and full["steps"][4]["upto"] == {"tokens_in": 910, "tokens_out": 121, "cost": 0.0052}
    assert full["state"]["attrs"]["hit_scores"] == [0.75, 0.5] and full["state"]["stages"] == ["embed", "retrieve"] and full["ts"] == "2026-05-04T03:02:01Z"
    assert json.loads(found["empty"])["steps"] == [] and "state" not in json.loads(session.as_json(traces).first().value)
