"""Toxic spans by a linear-chain conditional random field.

1. Document labels become token labels: over labelled documents, the word and prefix features
   that occur in toxic documents far more often than in others mark the tokens of toxic
   documents that carry them (``marked``).
2. A two-state chain with hashed features of each token (word, prefixes, length) is trained on
   labelled segments by gradient of the log-likelihood, with forward-backward sums.
3. Every whole text is tagged: forward and backward passes give each token's marginal. Runs of
   tokens above one half are the offending offsets; the sum, maximum and share of the marginals give the document's
   score through a logistic curve, fitted on labelled documents that the chain has not seen.

Fitting uses at most ``SAMPLE`` labelled documents of either class, drawn by hash, and ``SEGMENTS`` segments
of them; tagging is one map over all documents.

Defined results: null and empty texts have no tokens and the score of a document without marginals;
repeated rows get equal scores; of several labels for one id the largest counts; without labels of both
classes every score is 0.5 or less; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import _LOWER, blank_cut, materialise, mix, powers, prefix_sums, sampled

#: Labelled documents of either class, features that mark tokens, and segments, at most.
SAMPLE, MARKS, SEGMENTS = 6000, 4000, 6000
SEGMENT, BITS, STEPS = 48, 18, 160
PREFIXES = (4, 5, 6, 7)
#: How much more often a marking feature occurs in toxic documents: signed root of the likelihood ratio, which also holds
#: for rare features and classes (a normal approximation does not), and times.
ERRORS, TIMES = 4.0, 5.0
TAGGED = "doc_id long, score double, n_tokens long, spans array<struct<start:int,end:int,p:double>>"

_SOLID = np.zeros(256, bool)
_SOLID[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _SOLID[_a:_b] = True


def tokens(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the runs of letters and digits, and a row of feature hashes for each (0: none)."""
    starts, ends, rows, at = [], [], [], 0
    for part in blank_cut(raw):
        data = np.frombuffer(part.translate(_LOWER), np.uint8)
        solid = np.zeros(len(data) + 2, np.int8)
        solid[1:-1] = _SOLID[data]
        edge = np.flatnonzero(np.diff(solid))
        s, e = edge[::2], edge[1::2]
        sums, inverse = prefix_sums(data), powers(len(data) + 1)[1]
        out = np.zeros((len(s), 1 + len(PREFIXES)), np.uint64)
        out[:, 0] = mix((sums[e] - sums[s]) * inverse[s] + np.uint64(99))
        for k, n in enumerate(PREFIXES, 1):
            long = e - s >= n
            out[long, k] = mix((sums[s[long] + n] - sums[s[long]]) * inverse[s[long]] + np.uint64(n))
        starts.append(s + at)
        ends.append(e + at)
        rows.append(out)
        at += len(part)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(rows)


def _slots(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Weight indices of each token: hashed features, then one for its length."""
    hashed = np.where(rows != 0, (rows & np.uint64((1 << BITS) - 1)).astype(np.int64) + 17, 0)
    return np.concatenate([hashed, 1 + np.minimum(size, 15)[:, None]], axis=1)


@dataclass(frozen=True)
class Chain:
    """``weights``: log-odds of state 1 by slot; ``start`` and ``turn``: of the first state and of state pairs (00 is 0)."""

    weights: np.ndarray
    start: float
    turn: np.ndarray
    calibration: np.ndarray

    def emissions(self, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.weights[_slots(rows, size)].sum(1)

    def marginals(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Log-odds of state 1 for each token of each sequence, over whole sequences."""
        lengths = np.array([len(e) for e in emissions])
        order = np.argsort(-lengths, kind="stable")
        begin = np.cumsum(lengths) - lengths
        flat = np.concatenate([np.zeros(0), *emissions])
        forth, back = np.zeros_like(flat), np.zeros_like(flat)
        first, last = begin[order], (begin + lengths)[order]
        still = len(order) - np.searchsorted(np.sort(lengths), np.arange(1, (lengths.max() if len(lengths) else 0) + 1))
        for t, n in enumerate(still):
            i, j = first[:n] + t, last[:n] - 1 - t
            forth[i] = flat[i] + (_ahead(forth[i - 1], self.turn) if t else self.start)
            if t:
                back[j] = _behind(back[j + 1] + flat[j + 1], self.turn)
        odds = forth + back
        return [odds[b : b + n] for b, n in zip(begin, lengths, strict=True)]

    def scores(self, odds: list[np.ndarray]) -> np.ndarray:
        z = np.stack([summary(o) for o in odds]) @ self.calibration
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _ahead(r: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Log-odds of the next state from those of this one; ``turn``: a 2 x 2 table of log weights."""
    return np.logaddexp(turn[0, 1], turn[1, 1] + r) - np.logaddexp(turn[0, 0], turn[1, 0] + r)


def _behind(r: np.ndarray, turn: np.ndarray) -> np.ndarray:
    return np.logaddexp(turn[1, 0], turn[1, 1] + r) - np.logaddexp(turn[0, 0], turn[0, 1] + r)


def summary(odds: np.ndarray) -> np.ndarray:
    """One, and what a document's marginals say in sum, at most and at second most, and as a share."""
    p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    top = np.sort(np.partition(p, -2)[-2:]) if len(p) > 1 else np.append(np.zeros(2 - len(p)), p)
    return np.array([1.0, np.log1p(p.sum()), top[1], top[0], np.log1p(100 * p.sum() / max(len(p), 1))])


def train_chain(slots: np.ndarray, mask: np.ndarray, want: np.ndarray) -> Chain:
    """``slots``: segment, token, feature; ``mask`` and ``want``: segment, token."""
    n, length, _ = slots.shape
    size = (1 << BITS) + 17
    theta = np.zeros(size + 4)  # then start, 01, 10, 11
    theta[size] = -3
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    flat = slots[mask]
    for step in range(1, STEPS + 1):
        turn = np.array([[0, theta[size + 1]], [theta[size + 2], theta[size + 3]]])
        e = theta[slots].sum(2)
        e[~mask] = 0
        forth, back = np.zeros((n, length)), np.zeros((n, length))
        forth[:, 0] = e[:, 0] + theta[size]
        for t in range(1, length):
            forth[:, t] = e[:, t] + _ahead(forth[:, t - 1], turn)
        for t in range(length - 2, -1, -1):
            back[:, t] = np.where(mask[:, t + 1], _behind(back[:, t + 1] + e[:, t + 1], turn), 0)
        p = 1 / (1 + np.exp(-np.clip(forth + back, -30, 30)))
        grad = np.zeros_like(theta)
        grad[:size] = np.bincount(flat.ravel(), np.repeat((p - want)[mask], flat.shape[1]), size)
        grad[size] = (p - want)[:, 0].sum()
        both = mask[:, 1:]
        a, b = forth[:, :-1][both], (e + back)[:, 1:][both]
        pairs = np.stack([np.zeros_like(a), turn[0, 1] + b, turn[1, 0] + a, turn[1, 1] + a + b])
        pairs = np.exp(pairs - np.logaddexp.reduce(pairs, axis=0))
        y, y_next = want[:, :-1][both], want[:, 1:][both]
        real = np.stack([(1 - y) * (1 - y_next), (1 - y) * y_next, y * (1 - y_next), y * y_next])
        grad[size + 1 :] = (pairs - real).sum(1)[1:]
        grad = grad / n + 1e-4 * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        theta -= 0.1 * (1 - step / (STEPS + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = theta[:size].copy()
    weights[0] = 0
    return Chain(weights, float(theta[size]), np.array([[0, theta[size + 1]], [theta[size + 2], theta[size + 3]]]), np.array([-9.0, 0, 0, 0, 0]))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (p - y) + 1e-2 * w)
    return w


def marked(rows: DataFrame) -> dict[int, float]:
    """Features (hash: signed root of the likelihood ratio) that mark toxic tokens; ``rows``: text, toxic. At most ``MARKS``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.unique(tokens((t or "").encode("utf-8", "surrogatepass"))[2]) for t in batch["text"]]
            for toxic in (True, False):
                own = [f for f, y in zip(found, batch["toxic"], strict=True) if bool(y) == toxic]
                feature, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]), return_counts=True)
                n = n.astype(np.int64)
                yield pd.DataFrame({"feature": feature.view(np.int64), "bad": n * toxic, "fine": n * (not toxic)})

    sums = rows.select("text", "toxic").mapInPandas(count, "feature long, bad long, fine long").where("feature <> 0")
    n = rows.groupBy("toxic").count().collect()
    bad, fine = (max(1, sum(r["count"] for r in n if r["toxic"] == x)) for x in (True, False))
    sums = sums.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
    seen = (F.col("bad") + F.col("fine")) / F.lit(bad + fine)  # share of all documents with the feature

    def cell(found: Column, expected: Column) -> Column:
        return F.when(found > 0, found * F.log(found / expected)).otherwise(0.0)

    ratio = cell(F.col("bad"), seen * bad) + cell(F.col("fine"), seen * fine)
    ratio += cell(bad - F.col("bad"), (1 - seen) * bad) + cell(fine - F.col("fine"), (1 - seen) * fine)
    errors = F.signum(F.col("bad") - seen * bad) * F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))
    sums = sums.withColumn("errors", errors).where(F.col("errors") >= ERRORS).where(F.col("bad") / F.lit(bad) >= TIMES * F.col("fine") / F.lit(fine))
    return {r["feature"]: r["errors"] for r in sums.orderBy(F.desc("errors"), "feature").limit(MARKS).collect()}


def _segments(rows: DataFrame, marks: dict[int, float]) -> DataFrame:
    """Labelled segments; ``rows``: text, toxic."""
    known = np.array(sorted(marks), np.int64)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                start, end, found = tokens((text or "").encode("utf-8", "surrogatepass"))
                slots = _slots(found, end - start)
                want = np.isin(found.view(np.int64), known).any(1) & bool(toxic)
                parts = range(0, len(want), SEGMENT)
                # of segments without marked tokens, one in eight
                out = [(bool(want[i : i + SEGMENT].any()), slots[i : i + SEGMENT].ravel(), want[i : i + SEGMENT].astype(np.int8)) for k, i in enumerate(parts) if want[i : i + SEGMENT].any() or not (k + len(want)) % 8]
                yield pd.DataFrame(out, columns=["some", "slots", "want"])

    return rows.select("text", "toxic").mapInPandas(cut, "some boolean, slots array<int>, want array<tinyint>")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain:
    """A chain from ``labels`` (doc_id, toxic: boolean)."""
    one = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("boolean")).where("doc_id is not null and toxic is not null")
    one = one.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(4))
    ids = one.where("toxic").orderBy(order).limit(sample).union(one.where("not toxic").orderBy(order).limit(sample))
    rows = sampled(docs, materialise(ids, "toxic-ids"), 2 * sample, id_col, text).dropDuplicates(["text", "toxic"])
    rows = materialise(rows.withColumn("late", F.pmod(F.xxhash64("text"), F.lit(3)) == 0), "toxic-sample")
    early = rows.where("not late").repartition(12)
    segments = materialise(_segments(early, marked(early)), "toxic-segments")
    order = F.xxhash64("slots")
    few = segments.where("some").orderBy(order).limit(SEGMENTS // 2).union(segments.where("not some").orderBy(order).limit(SEGMENTS // 2)).toPandas()
    width = 2 + len(PREFIXES)
    slots, want, mask = np.zeros((len(few), SEGMENT, width), np.int64), np.zeros((len(few), SEGMENT)), np.zeros((len(few), SEGMENT), bool)
    for k, (s, y) in enumerate(zip(few["slots"], few["want"], strict=True)):
        slots[k, : len(y)], want[k, : len(y)], mask[k, : len(y)] = np.reshape(s, (-1, width)), y, True
    if not len(few) or not want.any():
        return Chain(np.zeros((1 << BITS) + 17), -9.0, np.zeros((2, 2)), np.zeros(5))
    chain = train_chain(slots, mask, want)
    late = summaries(rows.where("late").repartition(12), chain).toPandas()  # at most 2 * ``sample`` rows
    if late["toxic"].nunique() < 2:
        return chain
    return Chain(chain.weights, chain.start, chain.turn, _logistic(np.stack(late["x"].to_numpy()), late["toxic"].to_numpy(float)))


def _odds(chain: Chain, texts: pd.Series) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
    places, emissions = [], []
    for t in texts:
        start, end, rows = tokens((t or "").encode("utf-8", "surrogatepass"))
        places.append((start, end))
        emissions.append(chain.emissions(rows, end - start))
    return places, chain.marginals(emissions)


def summaries(rows: DataFrame, chain: Chain) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "x": [summary(o) for o in _odds(chain, batch["text"])[1]]})

    return rows.select("text", "toxic").mapInPandas(scan, "toxic boolean, x array<double>")


def _runs(text: str, start: np.ndarray, end: np.ndarray, odds: np.ndarray) -> list[tuple[int, int, float]]:
    """Offsets, in characters, of the runs of tokens with a marginal above one half, and the largest marginal of each."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], odds > 0, [False]]).astype(np.int8)))
    if not len(edge):
        return []
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(chars[start[a]]), int(chars[end[b - 1]]), float(1 / (1 + np.exp(-min(30.0, odds[a:b].max()))))) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def tag(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, n_tokens, spans (start, end in characters, p) of each document."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                places, odds = _odds(chain, part["text"])
                spans = [_runs(t or "", *p, o) for t, p, o in zip(part["text"], places, odds, strict=True)]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(), "score": chain.scores(odds), "n_tokens": [len(o) for o in odds], "spans": [[{"start": a, "end": b, "p": p} for a, b, p in s] for s in spans]}).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(scan, TAGGED)
