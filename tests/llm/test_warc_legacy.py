import hashlib

import pytest

from spanwright.llm import warc_legacy as w

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, version):
    long = "é<p>" * 50
    rows = [(1, "http://a/b c", long), (2, None, long), (2, "u", long), (None, "u", long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "HTTP/1.1 x\r\n\r\nWARC/1.0\r\n\r\n\n"), (7, "u", "x" * 3_000_000)]
    got = sorted(map(tuple, w.round_trip(spark.createDataFrame(rows, PAGES), version).collect()), key=str)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        again = page == 2
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=str)


def test_declared_versions_and_errors():
    body = b"2 0 owner\nURL ..."
    head = b"filedesc://x.arc 0.0.0.0 2001 text/plain 200 - - 0 x.arc %d\n" % len(body)
    record = b"http://h/ 1.2.3.4 20010203040506 text/html 200 - - 10 x.arc 5\nhello\n"
    (fields, block), = w.arc_records(head + body + b"\n" + record)
    out = w.warc_record(fields, block)
    assert block == b"hello" and b"WARC-Date: 2001-02-03T04:05:06Z" in out and b"WARC-Type: resource" in out and b"WARC-IP-Address: 1.2.3.4" in out
    for bad in (record[:-4], b"http://h/ x\n", head.replace(b"2 0", b"9 0") + body.replace(b"2 0", b"9 0")):
        with pytest.raises(ValueError):
            list(w.arc_records(bad))


def test_empty_table(spark):
    assert w.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_revisits_name_the_record_that_they_repeat(spark, tmp_path):
    long = "<p>same</p>" * 30
    w.write_arc(spark.createDataFrame([(5, "http://a/", long), (3, "http://b/", long), (9, "http://c/", long), (4, "http://d/", "other")], PAGES), str(tmp_path / "arc"))
    w.arc_to_warc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    records = [f for r in w.read_files(spark, str(tmp_path / "warc")).collect() for f, _ in w.warc_records(bytes(r.content)) if f["WARC-Type"] != "warcinfo"]
    of = {f["WARC-Target-URI"][7]: f for f in records}
    assert [of[k]["WARC-Type"] for k in "abcd"] == ["revisit", "response", "revisit", "response"]
    assert of["a"]["WARC-Refers-To"] == of["c"]["WARC-Refers-To"] == of["b"]["WARC-Record-ID"] and of["b"]["WARC-Record-ID"].startswith("<urn:uuid:")


@pytest.mark.parametrize("version", [1, 2])
def test_files_are_bounded_by_bytes_and_declare_their_version(spark, tmp_path, version):
    arc, warc = str(tmp_path / "arc"), str(tmp_path / "warc")
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"{k:04}" * (5000 if k == 7 else 250)) for k in range(20)], PAGES).coalesce(1)
    w.write_arc(pages, arc, version, most=3600)
    files = [bytes(r.content) for r in w.read_files(spark, arc).collect()]
    assert len(files) == 8  # the large page and two groups of 7 and 12, three to a file
    declared = [next(w.arc_records(f, whole=True)) for f in files]
    assert all(x["URL"].startswith("filedesc://pages-0-") and b.split()[0] == str(version).encode() for x, b in declared)
    assert sorted(len(list(w.arc_records(f))) for f in files) == [1, 1, 3, 3, 3, 3, 3, 3]
    w.arc_to_warc(spark, arc, warc)
    converted = [[f for f, _ in w.warc_records(bytes(r.content))] for r in w.read_files(spark, warc).collect()]
    assert len(converted) == 8 and all([f["WARC-Type"] for f in c] == ["warcinfo"] + ["response"] * (len(c) - 1) for c in converted)
    assert {c[0]["WARC-Filename"] for c in converted} == {x["URL"][11:] for x, _ in declared} and len({f["WARC-Record-ID"] for c in converted for f in c}) == 28
    assert sorted(r.page_id for r in w.read_warc(w.read_files(spark, warc)).collect()) == list(range(20))
