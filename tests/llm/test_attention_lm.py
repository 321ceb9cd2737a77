import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright.llm import attention_lm as m
from spanwright.llm.best_fit_packing import default_tokenizer, word_ids

WORDS = ["the", "cat,", "sat", "on", "a", "mat.", "élan", "x1y2", "unseen"]


def text(rng, n):
    return " ".join(WORDS[int(k)] for k in rng.integers(0, 8, n))


def test_base_score_and_counts_match_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(m, "HEAD", 4)
    rng = np.random.default_rng(0)
    rows = [(i, text(rng, 5 + 7 * i)) for i in range(30)] + [(30, "Unseen\tTHE cat, \n"), (31, None), (32, "")]
    got = {r.doc_id: r for r in m.score(documents(*rows), F.col("doc_id") < 30).collect()}
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None]
    c = Counter(w for i, t in rows if i < 30 for w in words(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        assert got[i].n_tokens == len(words(t)) and got[i].train_tokens == n
        assert got[i].n_known == sum(c[w] > 0 for w in words(t))
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)))
        assert got[i].score < 0
    assert got[31].score == got[32].score


def test_cut_gives_the_tokenizers_ids_and_marks_word_ends():
    ids = word_ids(default_tokenizer())
    texts = ["the cat, sat", "", "  x1y2\nélan ", None]
    c = m.cut(texts, ids)
    assert c.texts.tolist() == [4, 1, 3, 1]
    kept = np.insert(np.concatenate([ids(t or "") for t in texts]), np.cumsum([len(ids(t or "")) for t in texts]), 0)
    assert (c.symbols // 2).tolist() == kept.tolist()
    assert ((c.symbols % 2) == 1).sum() == c.texts.sum()


def test_each_symbol_is_scored_once_in_its_window():
    rng = np.random.default_rng(1)
    c = m.cut([text(rng, n) for n in (1, 30, 200)] + [""], word_ids(default_tokenizer()))
    n = np.bincount(c.symbols, minlength=m.SYMBOLS).astype(float)
    vocab = m.vocabulary(n, n, n)
    w = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in m.start(vocab.classes).items()}
    none = np.zeros(len(c.place), bool)
    by_class, unseen = m.log_probabilities(c, none, w, vocab)
    classes, lengths = m._laid_out(c, vocab.of)
    begin, end, first = m.windows_of(lengths)
    scored = [(b + s) for b, e, f in zip(begin, end, first) for s in range(1 + f, m.WINDOW + 1) if b + s < e]
    assert sorted(scored) == sorted(set(range(len(classes))) - set((np.cumsum(lengths + 1) - lengths - 1).tolist()))
    total = 0.0
    for b, e, f in zip(begin, end, first):
        x = np.zeros((1, m.WINDOW), np.int64)
        x[0, : min(m.WINDOW, e - b)] = classes[b : min(e, b + m.WINDOW)]
        z = m._hidden(w, x)["last"] @ w["o"] + w["ob"]
        z = z - np.log(np.exp(z).sum(1, keepdims=True))
        total += sum(z[s - 1, classes[b + s]] for s in range(1 + f, m.WINDOW + 1) if b + s < e)
    first_symbol = np.cumsum(c.sizes) - c.sizes
    kind = vocab.of[c.symbols[first_symbol]]
    assert (by_class + vocab.log_words[kind] + unseen - vocab.log_free[kind]).sum() == pytest.approx(total + vocab.inside[c.symbols].sum(), rel=1e-4)


def test_gradient_and_training_lower_the_loss():
    rng = np.random.default_rng(2)
    windows = np.tile(np.arange(m.WINDOW + 1) % 5, (64, 1)) + rng.integers(0, 2, (64, 1)) * 5
    w = m.start(np.log(np.full(m.CLASSES, 1 / m.CLASSES)))

    def loss(w):
        z = m._hidden(w, windows[:, :-1])["last"] @ w["o"] + w["ob"]
        return -(z - np.log(np.exp(z).sum(1, keepdims=True)))[np.arange(z.shape[0]), windows[:, 1:].ravel()].mean()

    assert loss(m.descend(w, windows, 60, 0, 0.01)) < 0.5 * loss(w)


def test_all_training_documents_train_the_model(spark, documents, monkeypatch):
    seen = {}
    real = m.materialise

    def counted(df, name):
        out = real(df, name)
        if name == "lm-windows":
            seen["weight"], seen["most"], seen["rounds"] = out.agg(F.sum("n"), F.max("n"), F.countDistinct("round")).head()
        return out

    monkeypatch.setattr(m, "materialise", counted)
    rng = np.random.default_rng(3)
    texts = [text(rng, 40) for _ in range(6)] + ["the cat, sat on a mat."] * 100
    n = np.ones(m.SYMBOLS)
    vocab = m.vocabulary(n, n, n)
    w = m.train(documents(*enumerate(texts)), vocab)
    lengths = m._laid_out(m.cut(texts, word_ids(default_tokenizer())), vocab.of)[1]
    assert seen["weight"] == pytest.approx(len(m.windows_of(lengths)[0])) and seen["most"] <= m.COPIES and seen["rounds"] > 1
    assert np.abs(w["o"]).max() > 0


def test_scores_do_not_depend_on_where_counts_are_met(documents, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, text(rng, 30) + f" only{i} élan{i}") for i in range(12)] + [(20, "only3 unseen the cat,"), (21, "only3")]

    def train(docs, vocab, tokenizer=None):
        own = np.random.default_rng(5)
        return {k: v + own.normal(0, 0.2, v.shape).astype(np.float32) for k, v in m.start(vocab.classes).items()}

    monkeypatch.setattr(m, "train", train)
    scores = []
    for head in (1 << 18, 3, 0):
        monkeypatch.setattr(m, "HEAD", head)
        scores.append({r.doc_id: r.score for r in m.score(documents(*rows), F.col("doc_id") < 20).collect()})
    assert scores[0] == pytest.approx(scores[1], rel=1e-12) and scores[0] == pytest.approx(scores[2], rel=1e-12)


def test_odd_rows(odd):
    rows = m.score(odd, F.col("doc_id").isNotNull()).collect()
    assert len(rows) == odd.count() and all(r.score < 0 and r.base_score < 0 for r in rows)
    rows = m.score(odd, F.lit(False)).collect()
    assert {r.n_known for r in rows} == {0} and {r.train_tokens for r in rows} == {0}
    assert m.score(odd.limit(0), F.lit(True)).count() == 0


def test_texts_are_tokenised_once(spark, tmp_path, documents, monkeypatch):
    rng = np.random.default_rng(6)
    path, gone = tmp_path / "documents", tmp_path / "gone"
    documents(*[(i, text(rng, 30)) for i in range(8)]).write.parquet(str(path))
    docs = spark.read.parquet(str(path))
    real = m.materialise

    def then_without_texts(df, name):
        out = real(df, name)
        if path.exists():
            path.rename(gone)
        return out

    monkeypatch.setattr(m, "materialise", then_without_texts)
    assert {r.doc_id for r in m.score(docs, F.col("doc_id") < 6).collect()} == set(range(8))


def test_stored_words_give_the_same_symbols_and_equal_texts_equal_numbers():
    class Ids:
        def of(self, words):
            return [b"" if w == b"dropped" else np.arange(len(w), dtype="<u4").tobytes() for w in words]

    texts = ["a dropped bcd", "", "dropped", None, "bcd a"]
    words = m.words_of(texts, Ids())
    assert m._unpacked(m._packed(words.place)).tolist() == words.place.tolist() and m._unpacked(m._packed(np.array([0, 70_000]))).tolist() == [0, 70_000]
    whole = words.cut()
    assert whole.symbols.tolist() == [1, m.NOTHING, 0, 2, 5, m.END, m.END, m.NOTHING, m.END, m.END, 0, 2, 5, 1, m.END] and whole.sizes.tolist() == [1, 1, 3, 1, 1, 1, 1, 1, 3, 1, 1]
    some = words.cut(np.array([False, True, False, False, True]))
    assert some.symbols.tolist() == [m.END, 0, 2, 5, 1, m.END] and some.texts.tolist() == [1, 3]
    rng = np.random.default_rng(8)
    same = text(rng, 300)
    c = m.cut([x for k in range(12) for x in (text(rng, 7 * k), same)], word_ids(default_tokenizer()))
    n = np.bincount(c.symbols, minlength=m.SYMBOLS).astype(float)
    vocab = m.vocabulary(n, n, n)
    w = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in m.start(vocab.classes).items()}
    by_class, _ = m.log_probabilities(c, np.zeros(len(c.place)), w, vocab)
    own = np.split(by_class, np.cumsum(c.texts)[:-1])[1::2]
    assert all((x == own[0]).all() for x in own)


def test_slopes_match_differences():
    rng = np.random.default_rng(9)
    rows = rng.integers(0, m.CLASSES, (5, m.WINDOW + 1))
    rows[2, 20:] = -1
    weight = np.array([1.0, 2, 1, 3, 1])
    w = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in m.start(np.zeros(m.CLASSES)).items()}

    def loss(w):
        z = (m._hidden(w, np.maximum(rows[:, :-1], 0))["last"] @ w["o"] + w["ob"]).astype(float)
        y = rows[:, 1:].ravel()
        each = np.where(y >= 0, np.repeat(weight, m.WINDOW), 0)
        return -(each * (z - np.log(np.exp(z).sum(1, keepdims=True)))[np.arange(len(y)), y]).sum() / each.sum()

    descent = m.Descent(w, 1, 0.0)
    descent.step(rows, weight)
    for name, slope in descent.g.items():
        way = rng.normal(0, 1, slope.shape)
        there, back = ({k: v.astype(float) for k, v in w.items()} for _ in range(2))
        there[name] += 1e-4 * way
        back[name] -= 1e-4 * way
        assert (loss(there) - loss(back)) / 2e-4 == pytest.approx((slope * way).sum(), rel=2e-2, abs=2e-4), name
