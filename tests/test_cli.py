import json

import pytest
from pyspark.sql import functions as F

from spanwright import settings
from spanwright.__main__ import main
from spanwright.operators import classify, incident
from spanwright.sources import artifacts, overrides, planted


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("traces") / "t.jsonl"
    planted.write_lines(planted.corpus(spark, days=20, per_day=12).coalesce(1), str(path))
    return str(path)


def test_demo_is_equal_byte_by_byte(spark, tmp_path, capsys):
    for k, parts in enumerate(("8", "3")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert main(["demo", "--out", str(tmp_path / str(k)), "--days", "20", "--per-day", "10"], spark) == 0
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    names = ["alerts.jsonl", "failures.jsonl", "report.md", "truth.jsonl"]
    assert sorted(x.name for x in (tmp_path / "0").iterdir() if not x.name.startswith(".")) == names
    assert all((tmp_path / "0" / n).read_bytes() == (tmp_path / "1" / n).read_bytes() for n in names)
    assert "precision 1.000, recall 1.000" in capsys.readouterr().out
    rows = [json.loads(x) for x in (tmp_path / "0" / "failures.jsonl").read_text().splitlines()]
    assert rows and all(list(r) == sorted(r) for r in rows)


def test_ingest_analyze_and_replay(spark, lines, tmp_path, capsys):
    store = str(tmp_path / "store")
    assert main(["ingest", lines, "--store", store], spark) == 0
    assert main(["analyze", "--store", store], spark) == 0
    assert main(["analyze", lines], spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0].startswith("240 traces") and out[1 : 1 + len(out[1:]) // 2] == out[1 + len(out[1:]) // 2 :]
    assert main(["replay", "--store", store, "--trace", "t-001-000003", "--at", "2"], spark) == 0
    assert main(["replay", lines, "--trace", "t-001-000003", "--json"], spark) == 0
    assert main(["replay", lines, "--trace", "t-001-000003", "--what-if"], spark) == 0
    text, *rest = capsys.readouterr().out.split("\n{", 1)
    assert text.startswith("trace t-001-000003 of harbour-desk") and "after step 2: embed, retrieve" in text and rest


def test_report_and_watch(spark, lines, tmp_path, capsys):
    (tmp_path / "own.json").write_text(json.dumps([{"taxonomy_id": "F-RET-001", "fix": "Buy a better index"}]))
    assert main(["report", lines, "--out", str(tmp_path), "--overrides", str(tmp_path / "own.json")], spark) == 0
    assert (tmp_path / "report.md").read_text().startswith("# Failure report\n")
    tickets = [json.loads(x) for x in (tmp_path / "tickets.jsonl").read_text().splitlines()]
    assert {x["ticket"].split("\n")[-1] for x in tickets if x["taxonomy_id"] == "F-RET-001"} == {"- to do: Buy a better index"}
    assert main(["watch", lines], spark) == 0
    assert all({"day", "statistic", "taxonomy_id", "type"} == set(json.loads(x)) for x in capsys.readouterr().out.splitlines())


def test_exit_code_when_nothing_can_be_read(spark, tmp_path, lines, capsys, monkeypatch):
    (tmp_path / "bad.jsonl").write_text("no\n")
    assert main(["analyze", str(tmp_path / "bad.jsonl")], spark) == 2 and main(["analyze", str(tmp_path / "none.jsonl")], spark) == 2
    assert main(["analyze"], spark) == 2 and main(["replay", lines, "--trace", "nobody"], spark) == 2
    monkeypatch.setenv("SPANWRIGHT_ALPHA", "much")
    assert main(["analyze", lines], spark) == 2
    assert "not a number" in capsys.readouterr().err


def test_settings(tmp_path):
    (tmp_path / "env").write_text("# limits\nSPANWRIGHT_REPEATS=7\nexport SPANWRIGHT_ALPHA='0.05'\nOTHER=1\n")
    s = settings.load({"SPANWRIGHT_ALPHA": "0.001"}, str(tmp_path / "env"))
    assert (s.repeats, s.alpha, s.low_score, s.limits().repeats) == (7, 0.001, 0.5, 7)
    for bad in ({"SPANWRIGHT_NOTHING": "1"}, {"SPANWRIGHT_REPEATS": "1.5"}):
        with pytest.raises(settings.SettingsError):
            settings.load(bad)
    (tmp_path / "env").write_text("just words\n")
    with pytest.raises(settings.SettingsError, match="line 1"):
        settings.load({}, str(tmp_path / "env"))


def test_entries_of_a_file(spark, tmp_path):
    path = tmp_path / "own.csv"
    path.write_text("taxonomy_id,title,stage\nF-RET-001,Nothing there,\nF-OWN-001,Ours,agent\n")
    rows = {r.taxonomy_id: r for r in overrides.entries(spark, str(path)).collect()}
    assert rows["F-RET-001"].title == "Nothing there" and rows["F-RET-001"].fix and rows["F-RET-001"].stage == "retrieve"
    assert (rows["F-OWN-001"].title, rows["F-OWN-001"].stage, rows["F-OWN-001"].fix) == ("Ours", "agent", None) and len(rows) == overrides.built_in(spark).count() + 1
    for text, what in (("taxonomy_id,color\nA,red\n", "unknown columns color"), ("title\nx\n", "no column taxonomy_id"), ("taxonomy_id,title\nA,x\nA,y\n", "two entries"), ("taxonomy_id,title\n,x\n", "without taxonomy_id"), ("taxonomy_id,stage\nA,nowhere\n", "nowhere is not a stage")):
        path.write_text(text)
        with pytest.raises(overrides.OverrideError, match=what):
            overrides.read(spark, str(path))


def test_pages_with_entries(spark, tmp_path):
    traces = planted.corpus(spark, days=3, per_day=15).persist()
    failures = classify.failures(traces).persist()
    plain, joined = (sorted(map(tuple, incident.pages(traces, failures, entries=e).collect())) for e in (None, overrides.entries(spark)))
    assert plain == joined and len(plain) > 5


def test_canonical_rows(spark):
    row = artifacts.canonical(spark.range(1).select(F.lit(None).cast("string").alias("b"), F.lit(-0.0000001).alias("c"), F.lit(0.12345678).alias("a"))).first().value
    assert row == '{"a":0.123457,"b":null,"c":0.0}'
