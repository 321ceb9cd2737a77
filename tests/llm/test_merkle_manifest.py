import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from spanwright.llm import merkle_manifest as m
from spanwright.llm import queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves, arity):
    """Root, and for each leaf its siblings by level as (left, right)."""
    level, proofs = [(d, [k]) for k, d in enumerate(leaves)], [[] for _ in leaves]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), arity):
            run = level[at : at + arity]
            for k, (_, members) in enumerate(run):
                for x in members:
                    proofs[x].append(([d for d, _ in run[:k]], [d for d, _ in run[k + 1 :]]))
            above.append((h(*(d for d, _ in run)), [x for _, members in run for x in members]))
        level = above
    return level[0][0], proofs


def brute(rows, arity=2):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    known = {}
    for lang, of in groups.items():
        of.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        known[lang] = tree([leaf(r) for r in of], arity)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    root, tops = tree([known[x][0] for x in langs], arity)
    out = []
    for lang, top in zip(langs, tops, strict=True):
        for r, own in zip(groups[lang], known[lang][1], strict=True):
            way = own + top
            value = leaf(r, int(r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0))
            for left, right in way:
                value = h(*left, value, *right)
            proof = h(*(d for left, right in way for d in left + right))
            out.append((r["doc_id"], leaf(r), known[lang][0], root, proof, value, value == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def made(n, langs):
    return [{"doc_id": (k * 7919) % 100_003, "source": None if k % 11 == 0 else f"s{k % 5}", "lang": langs[k % len(langs)], "n_chars": None if k % 13 == 0 else 10 ** (k % 6) - 1, "text": "" if k % 17 == 0 else f"té{k} " * (k % 4)} for k in range(n)]


@pytest.mark.parametrize("n, langs, arity", [(1, ["en"], 2), (2, ["en", None], 2), (97, ["en", "é", "zz", None], 2), (500, ["x"], 2), (301, [f"l{k}" for k in range(40)], 3), (260, ["a", "a", "a", "b"], 16)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, n, langs, arity):
    monkeypatch.setattr(m, "CHUNK", 8)  # many fragments, several rounds
    rows = made(n, langs)
    df = spark.createDataFrame(rows, SCHEMA)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(1)).otherwise(0)
    out = m.manifest(df, arity=arity, claim={"n_chars": F.col("n_chars") + tampered}).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows, arity)


def test_registered_query_over_odd_rows(spark, tmp_path):
    rows = made(40, ["en", None]) + made(3, ["en"]) * 2 + [{"doc_id": None, "source": None, "lang": None, "n_chars": None, "text": None}] * 2 + [{"doc_id": 5, "source": "", "lang": "", "n_chars": 2**63 - 1, "text": "long " * 50_000}]
    spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit(1)).withColumn("part", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows)
    assert not all(r.verified for r in out) and any(r.verified for r in out)


def test_empty_table_and_proofs(spark):
    assert m.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = m.manifest(spark.createDataFrame(made(9, ["a"]), SCHEMA), proofs=True).collect()
    assert all(h(r.proof) == r.proof_sha256 and len(r.proof) % 64 == 0 and r.verified for r in rows)


def test_merges_in_any_order():
    values = {(0, 0, k): h(str(k)) for k in range(13)} | {(1, 0, k): h("b", str(k)) for k in range(3)}
    ends = set()
    for step in (1, 3, 5, 7, 11):
        forest = m.Forest(2, 2)
        forest.sizes |= {0: 13, 1: 3}
        nodes = list(values)
        for k in range(16):
            node = nodes[k * step % 16]
            forest.add(node, values[node])
        ends.add(tuple(forest.open.items()))
    assert len(ends) == 1 and len(next(iter(ends))) == 1
