import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from spanwright.llm import conversation_trie as c
from spanwright.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {k: [(role, text) for *_, role, text in sorted(v)] for k, v in own.items()}
    made = {}
    for k in own:
        h = zlib.crc32(str(k).encode()) % 9
        made[k] = tuple(own.get(k - k % 5, [])[:h] + own[k][h:])
    members = {}
    for k, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(k)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in kids.get(node, [])) or 1
        saved[node] = sum(saved[x] for x in kids.get(node, [])) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    out = []
    for node, of in members.items():
        ends = ",".join(str(k) for k in sorted(of) if len(made[k]) == len(node))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def drawn(seed, convs, longest, words):
    rng = random.Random(seed)
    return [(k, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for k in range(convs) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("rows", [
    drawn(1, 60, 12, ["a", "é", ""]), drawn(2, 40, 4, ["x"]), drawn(3, 7, 40, ["x", "y"]),
    [(k, t, "user", f"same {t}") for k in range(120) for t in range(6)],
    [(5 * k, t, "user", "a" * (t < k)) for k in range(25) for t in range(k + 1)],
    [(1, None, None, None), (1, None, None, None), (1, 1, "u", None), (None, 1, "u", "lost"), (4, 2, "u", "x"), (4, 2, "u", "b"), (4, 2, "u", "x"), (10**15, 1, "u", "x")],
])
def test_equals_brute_force(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(c, "BLOCK", 4)
    spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit(1)).withColumn("size", F.lit("x")).write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.QUERIES["op13_conversation_trie"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, out), key=str) == brute(rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES["op13_conversation_trie"](spark, str(tmp_path)).count() == 0


def test_end_digests_in_runs(spark):
    ends = spark.range(1000).select((F.col("id") % 3).alias("conv_id"), F.lit(2).cast("long").alias("depth"), (F.col("id") * 7 % 1000).alias("ended"))
    want = {k: hashlib.sha256(",".join(str(x) for x in sorted(i * 7 % 1000 for i in range(k, 1000, 3))).encode()).hexdigest() for k in range(3)}
    assert {r.conv_id: r.ends_sha256 for r in c.end_digests(ends, at_once=10).collect()} == want
