import base64
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from spanwright.sources import pages
from spanwright.sources.records import IngestError

TRACES = [{"id": f"q{k}", "timestamp": f"2026-03-04T05:06:{k:02}Z", "name": "desk", "release": "7"} for k in range(7)] + [{"name": None}]
OBSERVATIONS = [
    {"id": "a", "traceId": "q0", "name": "embed", "level": "DEFAULT", "startTime": "2026-03-04T05:06:00Z", "endTime": "2026-03-04T05:06:00.012Z", "usage": {"input": 30}},
    {"id": "b", "traceId": "q0", "parentObservationId": "a", "name": "hybrid", "startTime": "2026-03-04T05:06:02Z", "endTime": "2026-03-04T05:06:01Z", "metadata": {"top_k": 4, "hit_scores": [0.5]}},
    {"id": "c", "traceId": "q0", "name": "answer", "level": "error", "usage": {"input": 1204, "output": 21}, "calculatedTotalCost": 0.0021, "cost": 9, "metadata": "none"},
    {"id": "d", "traceId": "q1", "name": "answer timeout", "cost": 0.5}, {"id": "e", "traceId": "", "name": "lost"}, {"traceId": "q1", "type": "TOOL"},
]


@pytest.fixture
def service():
    """A stub on this machine: pages of both kinds; fails as often as ``fails`` says."""

    class Handler(BaseHTTPRequestHandler):
        fails, asked = {}, []

        def do_GET(self):
            url = urlparse(self.path)
            kind, page, limit = url.path.strip("/"), *(int(parse_qs(url.query)[k][0]) for k in ("page", "limit"))
            Handler.asked.append((kind, page))
            code = Handler.fails.get(kind, []).pop() if Handler.fails.get(kind) else 200
            if self.headers["Authorization"] != "Basic " + base64.b64encode(b"me:word").decode():
                code = 401
            body = json.dumps({"data": {"traces": TRACES, "observations": OBSERVATIONS}[kind][(page - 1) * limit : page * limit]}).encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body if code == 200 else b"no")

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Handler.options = {"url": f"http://127.0.0.1:{server.server_port}/", "user": "me", "secret": "word", "wait": 0.01}
    yield Handler
    server.shutdown()


def test_pages_become_traces(spark, service):
    rows = {r.trace_id: r for r in pages.fetch(spark, limit=8, page_size=3, **service.options).collect()}
    assert len(rows) == 8 and "page-3-1" in rows and rows["page-3-1"].pipeline_name == "unknown"
    a = rows["q0"]
    assert [(s.pos, s.span_id, s.stage, s.status, s.duration_ms) for s in a.spans] == [(0, "a", "embed", "ok", 12.0), (1, "b", "retrieve", "ok", 0.0), (2, "c", "generate", "error", 0.0)]
    assert a.spans[1].attrs.hit_scores == [0.5] and a.spans[1].parent_id == "a" and (a.spans[2].tokens_in, a.spans[2].tokens_out) == (1204, 21)
    assert a.total_cost == pytest.approx(0.0021) and a.meta.release == "7" and a.ts.isoformat() == "2026-03-04T05:06:00"
    assert [s.status for s in rows["q1"].spans] == ["timeout", "ok"] and rows["q1"].total_cost == 0.5 and rows["q2"].spans == []


def test_limit_within_a_page(spark, service):
    spark.dataSource.register(pages.Pages)
    read = spark.read.format("pages").options(**{k: str(v) for k, v in service.options.items()}, kind="traces", limit="5", page_size="3").load()
    assert read.rdd.getNumPartitions() == 2
    assert [r.item.id for r in pages.items(read, "id string").orderBy("page", "i").collect()] == ["q0", "q1", "q2", "q3", "q4"]


def test_a_busy_service_is_asked_again(spark, service):
    service.fails["traces"] = [503, 429]
    assert pages.fetch(spark, limit=3, page_size=3, **service.options).count() == 3
    assert service.asked.count(("traces", 1)) >= 3
    service.fails["traces"] = [500] * 50
    with pytest.raises(Exception, match="the service answered 500"):
        pages.fetch(spark, limit=3, retries=1, **service.options).collect()
    service.fails.clear()
    with pytest.raises(Exception, match="answered 401"):
        pages.fetch(spark, limit=3, **(service.options | {"secret": "other"})).collect()


def test_recorded_pages_need_no_service(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"traces-{k}.json").write_text(json.dumps(TRACES[4 * k - 4 : 4 * k]))
    (tmp_path / "observations-1.json").write_text(json.dumps({"data": OBSERVATIONS}))
    rows = pages.fetch(spark, limit=100, page_size=4, recorded=str(tmp_path)).collect()
    assert len(rows) == 8 and max(len(r.spans) for r in rows) == 3


def test_without_credentials(spark):
    with pytest.raises(IngestError, match="needs url, user and secret"):
        pages.fetch(spark, url="http://127.0.0.1:9")
