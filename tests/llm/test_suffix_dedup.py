import hashlib
import random
from collections import Counter

import numpy as np

from spanwright.llm import suffix_array as sa
from spanwright.llm import suffix_dedup as d


def test_suffix_array_and_common_prefixes_match_sorting():
    rng = random.Random(1)
    for _ in range(200):
        t = np.array([rng.randint(1, rng.choice([2, 4, 200])) for _ in range(rng.randint(0, 120))] * rng.choice([1, 3]) + [0])
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert sa.suffix_array(t).tolist() == want
        data, room = t.astype(np.uint8), len(t) - np.arange(len(t))
        grams = Counter(tuple(t[i : i + 9].tolist()) for i in range(len(t) - 8))
        got = sa.common_prefix_reaches(data, sa.suffix_array(t, 9), room, 9)
        assert got.tolist() == [i + 9 <= len(t) and grams[tuple(t[i : i + 9].tolist())] > 1 for i in range(len(t))]


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        yield len(r), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()


def planted():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(70) for _ in range(3)]
    texts = [None, "", "short", "x" * 199, "y" * 200, "z" * 500, prose(300)]
    texts += [prose(rng.randint(0, 40)) + rng.choice(passages) + prose(rng.randint(0, 40)) for _ in range(30)]
    copy = prose(120)
    texts += [copy, copy, copy[:300] + "!" + copy[300:], passages[0][:201], passages[1][5:206], "ab" * 300]
    return texts


def test_report_matches_brute_force(documents):
    texts = planted()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in d.report(documents(*enumerate(texts))).collect()}
    for k, want in enumerate(brute(texts)):
        assert got[k] == want, k


def test_long_texts_go_in_parts(documents, monkeypatch):
    monkeypatch.setattr(d, "BUFFER", 300)
    rng = random.Random(4)
    a = "".join(rng.choice("abcdefgh ") for _ in range(2000))
    texts = [a, "q" + a[900:1500] + "r"]
    assert [x[1:] for x in sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in d.report(documents(*enumerate(texts))).collect())] == list(brute(texts))


def test_hot_anchors_are_counted(documents, monkeypatch):
    monkeypatch.setattr(d, "SHARD", 3000)
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    long, short = prose(700), prose(150)
    around = [prose(120) for _ in range(4)]
    texts = planted() + [prose(rng.randint(0, 90)) + rng.choice(around) + p + rng.choice(around) + prose(rng.randint(0, 90)) for p in [long, short] * 25]
    texts += [prose(150) + p + prose(150) for p in [long, short] * 25]
    docs = documents(*enumerate(texts))
    hot = []
    real = d.count_windows

    def counted(cuts):
        hot.append(cuts.groupBy("anchor").count().count())
        return real(cuts)

    monkeypatch.setattr(d, "count_windows", counted)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in d.report(docs).collect()}
    assert [got[k] for k in range(len(texts))] == list(brute(texts))
    assert hot and hot[0] > 1


def test_odd_rows(odd):
    wide = odd.withColumn("row", odd.doc_id).withColumn("spans", odd.text)
    assert d.remove_repeats(wide).columns == wide.columns
    assert d.remove_repeats(wide).count() == d.report(odd).count() == odd.count()
    assert d.report(odd.limit(0)).count() == 0


def test_documents_meet_their_spans_in_one_join(documents):
    texts = [*planted(), "é".join(map(str, range(150))) + "🙂"]
    cut = d.remove_repeats(documents(*enumerate(texts)))
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Union" not in plan  # else texts are shuffled once for each branch
    removed = {r.doc_id: r.n_removed for r in d.report(documents(*enumerate(texts))).collect()}
    left = {r.doc_id: r.text for r in cut.collect()}
    assert left[0] is None and left[1] == "" and left[len(texts) - 1] == texts[-1]
    assert all((left[k] or "") == (texts[k] or "") for k in left if not removed[k])
    assert all(len(left[k]) == len(texts[k]) - removed[k] for k in left if removed[k] and texts[k].isascii())
