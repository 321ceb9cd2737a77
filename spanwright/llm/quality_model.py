"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents that a label calls good; the unlabelled set is a sample of
all documents. A first classifier tells the two sets apart; among its scores on rows that it
has not seen, the least ratio of unlabelled to positive mass above any threshold estimates
the class prior (``class_prior``). The second one minimises the non-negative unbiased risk

    prior * E_positive[loss(+)] + max(0, E_unlabelled[loss(-)] - prior * E_positive[loss(-)])

with the logistic loss, so its output estimates the probability of quality. Labels of bad
documents are never used. Features describe the form of a whole text: shares of characters, shapes of
words, repetition and length, no ids or names.

Fitting uses at most ``SAMPLE`` rows of either set, drawn by hash; scoring is one map over all documents.

Defined results: null and empty texts get the score of a text without words; repeated rows get
equal scores; of several labels for one id the largest counts; without positives every score is 0.5; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import _SPACE, blank_cut, materialise, sampled, word_hashes

#: Positives, and unlabelled rows, that fitting uses at most.
SAMPLE = 6000
SHAPES, HIDDEN, STEPS, BATCH = 192, 24, 1500, 512
WIDTH = 128 + SHAPES + 8

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")


def features(text: str | None) -> np.ndarray:
    """Square roots of character and word-shape shares, then repetition and length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    chars, shapes, hashes = np.zeros(128), np.zeros(SHAPES), []
    for part in blank_cut(raw):
        data = np.frombuffer(part, np.uint8)
        kind = _CLASS[data]
        chars += np.bincount(kind, minlength=128)[:128]
        words = word_hashes(part)
        hashes.append(words)
        if len(kind):
            squeezed = kind[np.concatenate([[True], (kind[1:] != kind[:-1]) | _SPACE[kind[1:]]])]
            shapes += np.bincount((word_hashes(squeezed.tobytes()) % np.uint64(SHAPES)).astype(np.int64), minlength=SHAPES)
    words = np.concatenate(hashes)
    n, size = len(words), max(len(raw), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = words[1:] * np.uint64(3) + words[:-1] if n > 1 else words
    more = (np.log1p(n) / 10, (chars[list(b"aA0")].sum()) / max(n, 1) / 10, len(np.unique(words)) / max(n, 1), len(np.unique(pairs)) / max(len(pairs), 1), 1 - len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)) / 5, n / max(len(lines), 1) / 50, float(n == 0))
    return np.concatenate([np.sqrt(chars / size), np.sqrt(shapes / max(n, 1)), np.minimum(more, 4)]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return _forward(self.weights, np.clip((x - self.mean) / self.scale, -6, 6))[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _forward(w, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ w[0] + w[1])
    return (h @ w[2] + w[3])[:, 0] + (x @ w[4])[:, 0], h


def _descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int) -> tuple[np.ndarray, ...]:
    """Weights that tell the sets apart, or with a prior, that minimise the non-negative risk."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 0.1, (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, (HIDDEN, 1)), np.zeros(1), np.zeros((WIDTH, 1))]
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for step in range(1, STEPS + 1):
        p, u = positive[rng.integers(0, len(positive), BATCH)], unlabelled[rng.integers(0, len(unlabelled), BATCH)]
        x = np.concatenate([p, u])
        z, h = _forward(w, x)
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        up, down = s - 1, s  # slopes of log(1 + exp(-z)) and log(1 + exp(z))
        if prior is None:
            g = np.concatenate([up[:BATCH], down[BATCH:]]) / BATCH
        else:
            loss = np.logaddexp(0, z)
            rest = loss[BATCH:].mean() - prior * loss[:BATCH].mean()
            # where the estimate of the negatives' risk is below zero, step back from it
            if rest >= 0:
                g = np.concatenate([prior * (up - down)[:BATCH], down[BATCH:]]) / BATCH
            else:
                g = np.concatenate([prior * down[:BATCH], -down[BATCH:]]) / BATCH
        gh = g[:, None] @ w[2].T * (1 - h * h)
        rate = 2e-3 * min(1, 2 * (1 - step / (STEPS + 1)))
        for k, grad in enumerate((x.T @ gh + 1e-3 * w[0], gh.sum(0), h.T @ g[:, None] + 1e-3 * w[2], np.array([g.sum()]), x.T @ g[:, None] + 1e-3 * w[4])):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.999 * second[k] + 0.001 * grad * grad
            w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return tuple(w)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores: the least ratio of upper tails, with a bound for chance."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.9, 89))
    tail = lambda x: (x[None, :] >= cuts[:, None]).mean(1)
    p, u = tail(positive), tail(unlabelled)
    bound = np.sqrt(np.log(40) / 2 / len(positive)) + np.sqrt(np.log(40) / 2 / len(unlabelled))
    best = np.argmin((u + bound) / p)
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5) -> Model:
    both = np.concatenate([positive, unlabelled, np.zeros((1, WIDTH))])
    mean, scale = both.mean(0), both.std(0) + 0.02
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    if len(p) < 2 or len(u) < 2:
        return Model(mean, scale, tuple(np.zeros(s) for s in ((WIDTH, HIDDEN), HIDDEN, (HIDDEN, 1), 1, (WIDTH, 1))), 0.5)
    apart = _descend(p[::2], u[::2], None, seed)
    prior = class_prior(_forward(apart, p[1::2])[0], _forward(apart, u[1::2])[0])
    return Model(mean, scale, _descend(p, u, prior, seed + 1), prior)


def _with_features(rows: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"good": batch["good"], "x": [features(t) for t in batch["text"]]})

    return rows.select("text", "good").mapInPandas(scan, "good boolean, x array<float>")


def learn(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """A model from ``good`` (doc_id: trusted positives) and a sample of all ``docs``."""
    order = F.xxhash64("doc_id", F.lit(2))
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null")
    trusted = good.select(F.col("doc_id").cast("long")).distinct().orderBy(order).limit(sample)
    web = ids.orderBy(order).limit(sample).distinct()
    x = []
    for wanted, is_good in ((trusted, True), (web, False)):
        rows = sampled(docs, materialise(wanted.select("doc_id", F.lit(is_good).alias("good")), "quality-ids"), sample, id_col, text)
        found = _with_features(rows.repartition(12)).toPandas()  # at most ``sample`` rows of WIDTH numbers
        x.append(np.stack(found["x"].to_numpy()).astype(np.float64) if len(found) else np.zeros((0, WIDTH)))
    return fit(*x)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of each document."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                x = np.stack([features(t) for t in part["text"]]).astype(np.float64)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "score": model.scores(x)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(scan, "doc_id long, score double")
