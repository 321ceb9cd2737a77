import hashlib
import random
import re
import time

import pytest

from spanwright.llm import personal_data as p
from spanwright.llm import queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 // 10 + d * 2 % 10 for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def good(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = {k: [(m.start(), m.end()) for m in re.finditer(x, text or "") if good(k, m[0])] for k, x in BASE.items()}
    spans = [f"{k}:{s}:{e}" for k, of in found.items() for s, e in of]
    return [len(found[k]) for k in BASE], hashlib.sha256(",".join(spans).encode()).hexdigest(), spans


PARTS = ["a.b@c.d", "x@y.zz_q@r.ss", "@", ".", "-", "+", "+1 (017) 555-7713", "+4 99 12 34 56 78 90 12 3", "4845168114407329", "4845 1681 1440 7329", "4111-1111-1111-1111", "7536784127813050 4845168114407329", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "000255.01.0.9", " ", "\n", "é", "🙂", "word", "7", "12", "()", "%", "_", "DE89 3704 0044 0532 0130 00"]


@pytest.fixture(scope="module")
def found(spark):
    def run(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return {r.doc_id: [(x.kind, x.start, x.end) for x in r.found] for r in p.detect(df).collect()}

    return run


def test_base_spans_equal_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(600)] + [None, "", " "]
    rows = [(k, t, "n_email") for k, t in enumerate(texts)] + [(7, texts[7], None), (None, "a@b.c", None)]
    spark.createDataFrame(rows, "doc_id long, text string, found string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op12_personal_data"](spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and sum(r.doc_id == 7 for r in out) == 2
    for r in out:
        counts, digest, spans = brute("a@b.c" if r.doc_id is None else texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == digest
        assert [x for x in r.spans.split(",") if x.split(":")[0] in BASE] == spans


def test_added_spans(found):
    texts = [
        "IBAN: DE89 3704 0044 0532 0130 00 please", "DE88 3704 0044 0532 0130 00", "xDE89370400440532013000", "GB82WEST12345698765432.",
        "pay 7536784127813050 4845168114407329 by card", "order 7536784127813050 4845168114407329 (serial)", "call me: (212) 555-0142", "it was (212) 555-0142", "+1 (212) 555-0142 phone",
        "SSN 219-09-9999", "range 219-09-9999", "ssn 000-12-3456", "é🙂 account GB82 WEST 1234 5698 7654 32",
    ]
    out = found(texts)
    added = {k: [x for x in v if x[0] not in p.BASE] for k, v in out.items()}
    assert added[0] == [("iban", 6, 33)] and texts[0][6:33].endswith("00")
    assert added[1] == added[2] == []
    assert added[3] == [("iban", 0, 22)]
    assert luhn("7536784127813050") and luhn("4845168114407329")
    assert added[4] == [("card_run", 4, 20), ("card_run", 21, 37)] and added[5] == []
    assert added[6] == [("phone_local", 9, 23)] and added[7] == [] and added[8] == []
    assert added[9] == [("tax_id", 4, 15)] and added[10] == added[11] == []
    assert added[12] == [("iban", 11, 38)]


def test_card_alone_is_reported_once(found):
    assert found(["4845168114407329"])[0] == [("card", 0, 16)]


def test_long_texts_take_linear_time(found):
    n = 300_000
    texts = ["a" * n, "1" * n, "a@" + "b." * n + "c", "1." * n, "+1" + " " * n, "+1(" * n, "1 " * n, "a@b.c " * 20_000, "A" * n, "(" * n, "." * n + "@b.c"]
    began = time.time()
    out = found(texts)
    assert time.time() - began < 100
    assert len(out[7]) == 20_000 and out[7][-1] == ("email", 119_994, 119_999)
    assert out[2] == [("email", 0, 2 * n + 3)] and out[10] == [("email", 0, n + 4)]


def test_no_python_in_the_plan_and_empty_table(spark):
    empty = p.detect(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0
    plan = empty._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
