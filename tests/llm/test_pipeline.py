"""The whole pipeline on a small table, each stage against what it is to do."""

import random
import re

import pytest

import corpus_pipeline
from spanwright.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"word{k}" for k in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(70)
    out = {k: (text(120), "ab"[k % 2]) for k in range(20)}
    out |= {30: (out[0][0], "a"), 31: (out[1][0] + " end", "b"), 32: ("too short", "a"), 33: (None, "b"), 34: ("", None), 35: ("same " * 200, "a")}
    out |= {40 + k: (text(60) + " " + passage + " " + text(60), None) for k in range(2)}
    return out, passage


@pytest.fixture(scope="module")
def stages(spark, documents, texts):
    """What each stage returns, with a column more that clashes with inner names."""
    docs = documents(*((k, *v) for k, v in texts[0].items()))
    docs = docs.withColumn("row", docs.doc_id).withColumn("size", docs.text).withColumn("key", docs.source)
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, ""), "test-stage")
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_filters_keep_columns_and_clean_documents(stages, texts):
    docs, ruled, single, cut, mixed, _ = stages
    assert all(s.columns == docs.columns for s in (ruled, single, cut, mixed))
    assert ids(ruled) == ids(quality_rules.quality_filter(docs, "web-1")) == sorted([*range(20), 30, 31, 40, 41])
    assert ids(single) == sorted([*range(20), 40, 41])  # the copies 30 and 31 go, the first of each group stays
    left = {r.doc_id: r.text for r in cut.collect()}
    assert sorted(left) == ids(single) and all(left[k] == texts[0][k][0] for k in range(20))
    assert all(texts[1] not in left[k] and len(left[k]) >= len(texts[0][k][0]) - len(texts[1]) - 24 for k in (40, 41))  # neighbours begin alike


def test_mixing_comes_near_its_targets_and_packing_is_gapless(stages):
    _, _, _, cut, mixed, packed = stages
    size = lambda df: {s: sum(len(WORD.findall(r.text)) for r in df.collect() if r.source == s) for s in ("a", "b", None)}
    before, after = size(cut), size(mixed)
    weight, full = {"a": 3, "b": 1, None: 2}, set()
    while True:  # what a full source cannot take goes to the others by weight
        rest = 1.5 * sum(before.values()) - sum(2 * before[s] for s in full)
        target = {s: 2 * before[s] if s in full else rest * weight[s] / sum(w for x, w in weight.items() if x not in full) for s in weight}
        if not (over := {s for s in weight if target[s] > 2 * before[s]}):
            break
        full |= over
    assert all(after[s] <= 2 * before[s] and abs(after[s] - target[s]) <= 190 for s in before)  # no document has more words
    rows = sorted((r.sequence_id, r.offset, r.length) for r in packed.collect())
    at = {}
    for sequence, offset, length in rows:
        assert offset == at.get(sequence, 0)
        at[sequence] = offset + length
    assert max(at.values()) <= 2048
    assert len({(r.doc_id) for r in packed.collect()}) == len(set(ids(mixed)))


def test_an_empty_table_goes_through(spark, documents):
    docs = documents((1, "x")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, ""), "test-empty")
    assert docs.count() == 0
