import json

import pytest

from spanwright.sources import records


@pytest.fixture
def read(spark, tmp_path):
    def of(*lines, name="a.jsonl"):
        (tmp_path / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
        traces, bad = records.read_jsonl(spark, str(tmp_path / name))
        return {r.trace_id: r for r in traces.collect()}, sorted((r.line, r.reason) for r in bad.collect())

    return of


def test_lines_are_traces_or_rejected_by_their_number(read):
    traces, bad = read({"trace_id": "a", "spans": []}, "", "{torn", "[1]", {"spans": [{"stage": "llm"}]}, {"trace_id": "b", "spans": "x"}, {"trace_id": "c", "spans": [1]}, {"trace_id": "d", "ts": "soon", "spans": []}, "   ")
    assert set(traces) == {"a", "trace-l5"}
    assert bad == [(3, "not JSON"), (4, "not an object"), (6, "spans are not a list of objects"), (7, "spans are not a list of objects"), (8, "a time that cannot be read")]


def test_line_numbers_over_split_files(spark, tmp_path):
    for f in ("x.jsonl", "y.jsonl"):
        (tmp_path / f).write_text("".join(f'{{"trace_id": "{f}-{k}", "spans": []}}\n' for k in range(1, 2001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = records.numbered(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 1
        assert all(json.loads(r.value)["trace_id"] == f"{r.file.rsplit('/', 1)[1]}-{r.line}" for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_spans_of_a_native_record(read):
    spans = [
        {"span_id": "s", "parent_id": None, "name": "embed", "stage": "Embedding", "duration_ms": 12.5, "tokens_in": 40, "cost": 0.25, "attrs": {"model": "m"}},
        {"id": "own", "name": "call", "stage": "llm", "durationMs": 5, "status": "TIMEOUT", "tokensIn": 3, "tokensOut": 4}, {"stage": "mystery", "status": "odd"}, {"name": "x", "status": ""},
    ]
    traces, _ = read({"id": "t", "timestamp": "2026-01-02T03:04:05Z", "name": "desk", "spans": spans, "meta": {"env": "test"}})
    t = traces["t"]
    assert [(s.span_id, s.stage, s.status, s.duration_ms, s.tokens_in, s.tokens_out) for s in t.spans] == [("s", "embed", "ok", 12.5, 40, 0), ("own", "generate", "timeout", 5.0, 3, 4), ("mystery-2", "tool", "error", 0.0, 0, 0), ("x-3", "tool", "ok", 0.0, 0, 0)]
    assert (t.pipeline_name, t.total_cost, t.ts.isoformat(), json.loads(t.meta), t.spans[0].attrs.model) == ("desk", 0.25, "2026-01-02T03:04:05", {"env": "test"}, "m")


def test_evaluation_records(read):
    traces, _ = read(
        {"trace_id": "e", "query": "why?", "retrieved": [{"score": 0.5, "chunk_id": 1}, 0.25, {"chunk_id": 2}], "answer": "so", "context": "c", "retrieval_ms": 7, "metrics": {"faithfulness": 0.9}, "ts": 1_700_000_000},
        {"question": "who?", "hits": [], "output": "me", "ts": 1_700_000_000_000},
    )
    a, b = traces["e"].spans
    assert [(s.span_id, s.parent_id, s.stage, s.duration_ms) for s in (a, b)] == [("e-retrieve", None, "retrieve", 7.0), ("e-generate", "e-retrieve", "generate", 0.0)]
    assert (a.attrs.query, a.attrs.top_k, a.attrs.hit_count, a.attrs.hit_scores) == ("why?", 2, 2, [0.5, 0.25])
    assert (b.attrs.output, b.attrs.context, b.attrs.prompt_chars) == ("so", "c", 8)
    assert json.loads(traces["e"].meta) == {"source": "evaluation", "metrics": {"faithfulness": 0.9}}
    other = traces["trace-l2"]
    assert (other.spans[0].attrs.hit_count, other.spans[1].attrs.output, other.ts) == (0, "me", traces["e"].ts)


def test_a_bare_span_is_a_trace(read):
    traces, _ = read({"trace_id": "one", "span_id": "s", "stage": "rerank", "cost": 0.5, "pipeline_name": "p"}, {"stage": "guard"})
    assert [(s.span_id, s.stage) for s in traces["one"].spans] == [("s", "rerank")] and traces["one"].total_cost == 0.5 and traces["one"].pipeline_name == "p"
    assert traces["trace-l2"].spans[0].stage == "guard"


def test_documents_and_dispatch(spark, tmp_path):
    (tmp_path / "many.json").write_text(json.dumps([{"trace_id": "a", "spans": []}, 7, {"trace_id": "b", "spans": []}], indent=1))
    (tmp_path / "one.json").write_text(json.dumps({"trace_id": "c", "spans": []}, indent=1))
    traces, bad = records.read_json(spark, str(tmp_path / "many.json"))
    assert sorted(r.trace_id for r in traces.collect()) == ["a", "b"] and [(r.line, r.reason) for r in bad.collect()] == [(1, "not an object")]
    assert [r.trace_id for r in records.load(spark, str(tmp_path / "one.json")).collect()] == ["c"]
    (tmp_path / "none.ndjson").write_text("x\ny\n")
    with pytest.raises(records.IngestError, match="line 1, not JSON"):
        records.load(spark, str(tmp_path / "none.ndjson"))
    (tmp_path / "empty.jsonl").write_text("")
    with pytest.raises(records.IngestError):
        records.load(spark, str(tmp_path / "empty.jsonl"))
