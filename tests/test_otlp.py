import base64
import json

import pytest
from pyspark.sql import functions as F

from spanwright.sources import otlp

T1, S1 = "AB" * 16, "0x" + "1c" * 8


def kv(**named):
    kind = lambda v: "boolValue" if isinstance(v, bool) else "intValue" if isinstance(v, int) else "doubleValue" if isinstance(v, float) else "stringValue"
    return [{"key": k.replace("__", "."), "value": v if isinstance(v, dict) else {kind(v): str(v) if kind(v) == "intValue" else v}} for k, v in named.items()]


def span(span_id, trace=T1, **more):
    return {"traceId": trace, "spanId": span_id, "name": "step"} | more


def export(*spans, scope="lib", **resource):
    return {"resourceSpans": [{"resource": {"attributes": kv(service__name="shop", **resource)}, "scopeSpans": [{"scope": {"name": scope}, "spans": list(spans)}]}]}


@pytest.fixture
def read(spark):
    def go(*documents):
        rows = [(k, d if isinstance(d, str) else json.dumps(d)) for k, d in enumerate(documents)]
        return otlp.entries(spark.createDataFrame(rows, "doc long, value string"))

    return go


def test_ids_order_times_and_measures(read):
    docs = {"arrayValue": {"values": [{"kvlistValue": {"values": kv(document__score=0.5, document__content="first")}}, {"kvlistValue": {"values": kv(score=0.25, content="second")}}]}}
    late = span(S1, startTimeUnixNano="2000000001500", endTimeUnixNano="2000900001500", name="ask the model", attributes=kv(gen_ai__usage__input_tokens=12, cost=0.5, gen_ai__prompt="héllo", gen_ai__completion="answer"))
    early = span("2D" * 8, T1.lower(), startTimeUnixNano=1000000000000, durationNanos="900000000", name="lookup", parentSpanId="0" * 16, attributes=kv(retrieval__documents=docs, retrieval__query="why", top_k=" 7 "))
    third = span(base64.b64encode(bytes(range(8))).decode()[:-1] + "=", startTimeUnixNano="2000000001500", parentSpanId=S1, status={"code": "STATUS_CODE_ERROR", "message": "broken"})
    one = otlp.traces(otlp.spans(read(export(late, early, third, zone="eu"), export(zone="us")))).collect()
    assert len(one) == 1 and one[0].trace_id == T1.lower() and one[0].pipeline_name == "shop" and one[0].meta.scopes == ["lib"] and one[0].meta.resource == {"zone": "eu"}
    a, b, c = one[0].spans
    assert [x.pos for x in one[0].spans] == [0, 1, 2] and (a.name, b.span_id, c.parent_id) == ("lookup", "1c" * 8, "1c" * 8)
    assert (a.stage, a.duration_ms, a.parent_id, a.attrs.hit_count, a.attrs.hit_scores, a.attrs.context, a.attrs.query, a.attrs.top_k) == ("retrieve", 900.0, None, 2, [0.5, 0.25], "first\nsecond", "why", 7)
    assert (b.stage, b.duration_ms, b.tokens_in, b.cost, b.attrs.output, b.attrs.prompt_chars, b.status) == ("generate", 900.0, 12, 0.5, "answer", 5, "ok")
    assert (c.status, c.attrs.error, c.stage) == ("error", "broken", "tool") and one[0].total_cost == 0.5
    assert one[0].ts.timestamp() == 1000.0


def test_unknown_start_keeps_document_order_and_plain_attributes(read):
    spans = [span("01" * 8, startTimeUnixNano="9"), span("02" * 8, attributes={"gen_ai.response.finish_reasons": ["length"], "llm.output_messages": [{"content": "a"}, {"text": "b"}], "match.count": "3", "stage": "LLM"}), span("03" * 8, startTimeUnixNano="1", name="TimeOut")]
    found = otlp.traces(otlp.spans(read(export(*spans)))).head()
    assert [x.span_id[:2] for x in found.spans] == ["01", "02", "03"] and [x.status for x in found.spans] == ["ok", "ok", "timeout"]
    b = found.spans[1]
    assert (b.stage, b.attrs.finish_reason, b.attrs.output, b.attrs.hit_count) == ("generate", "length", "a\nb", 3)


def test_wrong_shapes_are_counted(read):
    good = span(S1)
    bad = [7, span(None), span("xyz!"), span(S1, trace="?")]
    document = [export(good, *bad), 5, {"resourceSpans": 3}, {"resourceSpans": [1, {"scopeSpans": 2}, {"scopeSpans": [3, {"spans": 4}]}, {}]}, {}]
    rows = read(document, "[]", "null")  # a null request is no request either
    assert {r.level: (r.skipped, len(r.reasons)) for r in otlp.skips(rows).collect()} == {"span": (4, 4), "resource": (5, 5), "scope": (2, 2)}
    assert otlp.spans(rows).count() == 1
    assert otlp.traces(otlp.spans(read())).count() == 0


def test_text_that_is_not_json_fails(read):
    with pytest.raises(Exception, match="not JSON"):
        read("{nope").collect()


def test_documents_and_queries(spark):
    docs = [
        {"document.score": 0.9, "score": 0.1, "document.content": "one"}, {"document.score": None, "score": 0.2}, {"score": "0.3", "content": "two"}, 0.4, "0.5", None, {"content": ""}, {"score": 1},
    ]
    cases = {
        "full": ({"retrieval.documents": docs, "retrieval.query.text": "by prefix", "match.count": "3"}, ([0.9, 0.4, 1.0], 8, "one\ntwo", "by prefix")),
        "named": ({"search.query": "own", "retrieval.query.text": "other", "match.count": " 3 "}, (None, 3, None, "own")),
        "null": ({"query": None, "retrieval.query.text": "other", "retrieval.documents": "none"}, (None, None, None, None)),
    }
    rows = spark.createDataFrame([(k, json.dumps(v[0])) for k, v in cases.items()], "k string, j string")
    found = otlp.canonical(F.from_json("j", "map<string,string>"))
    got = {r.k: (r.hit_scores, r.hit_count, r.context, r.query) for r in rows.select("k", *(found[n].alias(n) for n in ("hit_scores", "hit_count", "context", "query"))).collect()}
    assert got == {k: v[1] for k, v in cases.items()}
