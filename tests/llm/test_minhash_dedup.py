import random
import re

from spanwright.llm import minhash_dedup as m
from spanwright.llm.graph import components


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(texts, percent, width):
    sets = [shingles(t, width) for t in texts]
    of = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]) and of[i] != of[j]:
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    return [(len(s), c) for s, c in zip(sets, of, strict=True)]


def test_matches_brute_force(documents):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(300)]
    base = lambda n: [rng.choice(vocabulary) for _ in range(n)]

    def edited(words, share):
        return [rng.choice(vocabulary) if rng.random() < share else w for w in words]

    passage, texts = base(60), [None, "", " \n", "one", "One", "a b", "a b c d", "x y z x y z x y z"]
    for _ in range(12):
        words = base(rng.choice([8, 20, 90, 300]))
        texts += [" ".join(edited(words, rng.choice([0, 0.004, 0.01, 0.03, 0.05]))) for _ in range(rng.randint(1, 7))]
    texts += [" ".join(base(20) + passage + base(20)) for _ in range(60)]  # a passage that links nothing
    giant = base(150)
    texts += [" ".join(edited(giant, rng.choice([0.005, 0.02, 0.03, 0.04]))) for _ in range(120)]  # longer than the short lists
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.near_duplicates(documents(*enumerate(texts)), 85, 3).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, 85, 3)


def test_different_documents_of_a_template_make_no_pairs(documents, monkeypatch):
    rng = random.Random(3)
    words = lambda n, of: [f"{of}{rng.randrange(10**9)}" for _ in range(n)]
    first, last = words(80, "t"), words(80, "t")
    texts = [" ".join(first + words(rng.randint(24, 28), "o") + last) for _ in range(120)]
    texts += [t + " more" for t in texts[:5]]  # these have a partner
    found = {}
    real = m.materialise

    def counted(df, name):
        out = real(df, name)
        found[name] = max(found.get(name, 0), out.count())
        return out

    monkeypatch.setattr(m, "materialise", counted)
    monkeypatch.setattr(m, "BLOCK", 10)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.near_duplicates(documents(*enumerate(texts)), 80, 5).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, 80, 5)
    assert found["near-lists"] and found["near-unmet"] <= len(texts)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (99, 98), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {98: 98, 99: 98, 100: 98}


def test_one_of_each_and_odd_rows(documents, odd):
    text = " ".join(f"w{k}" for k in range(80))
    docs = documents((5, text), (3, text + " more"), (9, "something else entirely"), (9, "something else entirely"), (1, None), (None, text))
    kept = m.one_of_each(docs.withColumn("id", docs.doc_id).withColumn("label", docs.text))
    assert sorted((r.doc_id, r.text is None) for r in kept.collect()) == [(1, True), (3, False), (9, False)]
    assert m.near_duplicates(odd).count() == odd.count()
    assert m.near_duplicates(odd.limit(0)).count() == 0
