"""Registered queries on whole small tables: splits, leakage, and brute force where SQL cannot say it."""

import collections
import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from spanwright.llm import queries

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{DATA}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def labels():
    return pq.read_table(f"{DATA}/labels.parquet").to_pylist()


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    def of(name, **tables):
        path = tmp_path_factory.mktemp("tables")
        for t, rows in tables.items():
            pq.write_table(pa.Table.from_pylist(rows, schema=pq.read_schema(f"{DATA}/{t}.parquet")), path / f"{t}.parquet")
        return queries.QUERIES[name](spark, str(path)).collect()

    return of


@pytest.mark.parametrize(("name", "label", "n", "out", "least"), [("op2_toxic_spans", "toxic", 3, 1, 0.7), ("op6_quality_model", "quality", 5, 0, 0.3)])
def test_scores_know_neither_held_out_labels_nor_other_columns(run, docs, labels, name, label, n, out, least):
    rows = {r.doc_id: r for r in run(name, documents=docs, labels=labels)}
    assert set(rows) == {d["doc_id"] for d in docs}
    for r in rows.values():
        assert r.held_out == (crc(r.doc_id) % n == out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
    other = [d | {"lang": "xx", "source": f"s{k % 7}", "n_chars": 1} for k, d in enumerate(docs)]
    turned = [x | {label: 1 - x[label]} if crc(x["doc_id"]) % n == out and x[label] is not None else x for x in labels]
    assert turned != labels
    again = {r.doc_id: r for r in run(name, documents=other, labels=turned)}
    assert all(again[i].score == pytest.approx(rows[i].score, abs=1e-9) for i in rows)


def test_equal_texts_have_equal_scores(run, docs, labels):
    twins = docs + [d | {"doc_id": d["doc_id"] + 1_000_000} for d in docs]
    for name in ("op2_toxic_spans", "op6_quality_model"):
        rows = {r.doc_id: r.score for r in run(name, documents=twins, labels=labels)}
        assert all(rows[d["doc_id"]] == rows[d["doc_id"] + 1_000_000] for d in docs)


def test_language_model_learns_from_its_own_documents_only(run, docs):
    few = [d for d in docs if len(d["text"] or "") < 4000][:60]
    rows = {r.doc_id: r for r in run("op9_attention_lm", documents=few)}
    tokens = lambda d: [w.encode("utf-8", "surrogatepass") for w in WORD.findall((d["text"] or "").translate({c: c + 32 for c in range(65, 91)}))] + [None]
    counts = collections.Counter(t for d in few if crc(d["doc_id"]) % 7 != 2 for t in tokens(d))
    total = sum(counts.values())
    for d in few:
        r, own = rows[d["doc_id"]], tokens(d)
        assert r.held_out == (crc(d["doc_id"]) % 7 == 2) and (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(t in counts for t in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + len(counts) + 1)) for t in own), abs=1e-6)
        assert r.score < 0 and math.isfinite(r.score)
    changed = [d | {"text": "entirely other words here"} if crc(d["doc_id"]) % 7 == 2 else d for d in few]
    again = {r.doc_id: r for r in run("op9_attention_lm", documents=changed)}
    for d in few:
        if crc(d["doc_id"]) % 7 != 2:
            assert again[d["doc_id"]].score == pytest.approx(rows[d["doc_id"]].score, rel=1e-6)


def test_source_mix_reaches_its_targets(run, docs):
    rows = run("op3_source_mix", documents=docs)
    size = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in docs}
    source = {d["doc_id"]: d["source"] for d in docs}
    sums, taken, target = collections.Counter(), collections.Counter(), {}
    for i, s in source.items():
        sums[s] += size[i]
    for r in rows:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sums[s] and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        target[s] = r.target
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sums, key=lambda s: (s is None, s)))}
    want, open_, left = {}, set(sums), 1.5 * sum(sums.values())
    while open_:
        over = {s for s in open_ if left * weights[s] / sum(weights[x] for x in open_) > 2 * sums[s]}
        if not over:
            want |= {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
            break
        want |= {s: 2.0 * sums[s] for s in over}
        left, open_ = left - sum(2 * sums[s] for s in over), open_ - over
    assert all(target[s] == pytest.approx(want[s]) for s in sums)
    largest = {s: max(size[i] for i in source if source[i] == s) for s in sums}
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sums)
    assert sorted(rows) == sorted(run("op3_source_mix", documents=docs[::-1]))


def test_neighbours_against_all_pairs(run):
    table = pq.read_table(f"{DATA}/embeddings.parquet")
    vectors = table.to_pylist()
    name = next(c for c in table.column_names if c != "vec_id" and isinstance(vectors[0][c], list))
    good = {v["vec_id"]: np.array(v[name], float) for v in vectors if v[name] is not None and all(x is not None and math.isfinite(x) for x in v[name]) and any(v[name])}
    found = collections.defaultdict(list)
    for r in sorted(run("op4_neighbour_search", embeddings=vectors), key=lambda r: (r.query_id, r.rank)):
        assert r.score == pytest.approx(np.linalg.norm(good[r.query_id] - good[r.vec_id]), abs=1e-9)
        found[r.query_id].append((r.rank, r.score, r.vec_id))
    assert set(found) == {i for i in good if i % 100 == 0}
    hits = total = 0
    for q, rows in found.items():
        assert [k for k, *_ in rows] == list(range(1, len(rows) + 1)) and [x[1:] for x in rows] == sorted(x[1:] for x in rows)
        best = sorted((np.linalg.norm(good[q] - v), i) for i, v in good.items() if i != q)[:10]
        hits, total = hits + len({i for _, i in best} & {i for *_, i in rows}), total + len(best)
    assert hits >= 0.9 * total


def test_repeated_strings_against_brute_force(run, docs):
    raw = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    seen = collections.Counter(t[k : k + 200] for t in raw.values() for k in range(len(t) - 199))
    for r in run("op5_suffix_dedup", documents=docs):
        text = raw[r.doc_id]
        gone = np.zeros(len(text) + 201, int)
        for k in range(len(text) - 199):
            if seen[text[k : k + 200]] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        off = np.cumsum(gone)[: len(text)] > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], off.astype(int), [0]])) == 1)
        left = bytes(b for b, x in zip(text, off, strict=True) if not x)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(text), int(off.sum()), len(edges), hashlib.sha256(left).hexdigest())


def test_packing_against_the_tokenizer(run, docs):
    import sys

    sys.path.append("/opt/tokenizers")
    import public_tokenizers

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    rows = run("op10_best_fit_packing", documents=docs)
    ids = {d["doc_id"]: [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0] for d in docs}
    want = {(i, p): x[p * 2048 : (p + 1) * 2048] for i, x in ids.items() for p in range(-(-len(x) // 2048))}
    assert len(rows) == len(want)
    held = collections.defaultdict(list)
    for r in rows:
        piece = want[(r.doc_id, r.piece)]
        assert (r.start, r.length, r.ids_crc32) == (2048 * r.piece, len(piece), zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)))
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 2048
    gaps = []  # plain best fit over falling lengths
    for n in sorted((len(x) for x in want.values()), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((2048 if fit is None else fit) - n)
    assert len(held) <= len(gaps)
