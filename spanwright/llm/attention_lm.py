"""Language-model scores by a causal self-attention model, in numpy, over subword ids.

0. Texts are cut into words and ids once; what follows reads these.
1. Corpus counts: of every word and of every symbol in all training documents. A symbol is a subword
   id and whether a word ends with it, so that no word's symbols begin another word's.
2. Symbols have classes by frequency: the most frequent are a class each, the others share classes of like
   mass. P(symbol | context) = P(class | context) * P(symbol | class); the second factor
   comes from the counts, the first from the attention model.
3. The model trains on the windows of all training documents, which do not overlap, so every symbol is learned once; equal
   ones are one with a weight. It trains in rounds, each
   on its share of the windows: every partition descends on its own from the same weights, batch by batch, then weights
   are averaged. Windows with many copies are dealt to several rounds and partitions.
4. Whole texts are cut into overlapping windows; every symbol is scored once, with at least ``WINDOW - STRIDE``
   symbols of context where there are so many, in batches of masked attention.
5. A word's probability is that of its first symbol's class, times its share in the corpus among the words that
   begin in this class, less a discount of ``DISCOUNT`` counts; what discounts set free goes, for known words too, to the
   product over the word's symbols. Counts of at most ``HEAD`` most frequent words, all above a count that a histogram
   of counts gives, are at hand in the scan; all other words meet their counts in a join.
6. ``word_score`` is the log probability in the outcomes that the base has: a known word has its share without the spelling, and all
   unknown words that begin in one class are one outcome, with all that discounts set free. ``score`` spells unknown words.

Defined results: a null or empty text is the end mark alone; repeated rows get equal scores;
without training documents symbols are uniform; words that the tokenizer drops are one reserved symbol; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import _LOWER, blank_cut, materialise, partitions, word_places
from .best_fit_packing import WordIds, default_tokenizer, word_ids

#: Symbols: two for each id of the vocabulary. Id 0 is the end mark; its other symbol stands for words without ids.
SYMBOLS = 2 * 49408
END, NOTHING = 1, 0
#: What each word's count lends to words that were not seen.
DISCOUNT = 0.75
#: Classes of one symbol, and of several.
SINGLE, SHARED = 200, 24
CLASSES = SINGLE + SHARED
WINDOW, STRIDE, WIDTH, INNER = 32, 24, 16, 32
#: Copies of a window that one row stands for, at most.
COPIES = 16
ROUNDS, BATCH, LEAST_STEPS = 4, 128, 120
#: Words whose counts every task holds.
HEAD = 1 << 18
#: Words whose ids a worker remembers.
REMEMBERED = 250_000
#: Windows that are scored at once.
CHUNK = 64
_HASH_END = -0x5B1D  # the end mark as a word

SCORED = "row long, doc_id long, n_tokens long, head_known long, head_sum double, head_lm double, head_word double, tail array<long>, parts array<double>, free array<double>"
TOKENISED = "row binary, doc_id binary, named binary, learns binary, keys binary, place binary, sizes binary, ids binary, texts binary"
#: Steps of the histogram of counts for each doubling.
FINE = 16


@dataclass(frozen=True)
class Cut:
    """Words and symbols of some texts, one after the other, each text with its end mark."""

    keys: np.ndarray  # hashes of the different words
    place: np.ndarray  # of each word among them
    sizes: np.ndarray  # symbols in each word
    symbols: np.ndarray
    texts: np.ndarray  # words in each text


@dataclass(frozen=True)
class Words:
    """Words of some texts, with the ids of each different word; ``sizes`` is 0 where the tokenizer drops a word."""

    keys: np.ndarray
    place: np.ndarray
    sizes: np.ndarray  # ids of each different word
    ids: np.ndarray  # one different word after the other
    texts: np.ndarray  # words in each text

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the different words, one after the other, and how many each has."""
        width = np.maximum(self.sizes, 1).astype(np.int64)
        last = np.cumsum(width) - 1
        codes = np.zeros(width.sum(), np.int32)
        held = np.ones(len(codes), bool)
        held[last[self.sizes == 0]] = False
        codes[held] = 2 * self.ids.astype(np.int32)
        codes[last] += 1
        codes[last[self.sizes == 0]] = NOTHING
        return codes, width

    def cut(self, wanted: np.ndarray | None = None) -> Cut:
        """All words and symbols, of the ``wanted`` texts only if these are given."""
        place, texts = self.place, self.texts
        if wanted is not None:
            place, texts = place[np.repeat(wanted, texts)], texts[wanted]
        codes, width = self.codes()
        each, begin = width[place], (np.cumsum(width) - width)[place]
        return Cut(self.keys, place, each, codes[np.repeat(begin - (np.cumsum(each) - each), each) + np.arange(each.sum())], texts)


def words_of(texts: list[str | None], ids_of: WordIds) -> Words:
    """Whole texts, lower-cased, as words. Only different words meet the tokenizer."""
    hashes: list[np.ndarray] = [np.zeros(0, np.int64)]
    distinct: dict[int, bytes] = {}
    number = np.zeros(len(texts), np.int64)

    def flush(buffer: list[tuple[int, bytes]]) -> None:
        raw = b"\n".join(part for _, part in buffer)
        found, start, end = word_places(raw)
        ends = np.cumsum([len(part) + 1 for _, part in buffer])
        np.add.at(number, np.array([k for k, _ in buffer])[np.searchsorted(ends, start, "right")], 1)
        hashes.append(found.view(np.int64))
        word, where = np.unique(hashes[-1], return_index=True)
        first, after = start[where].tolist(), end[where].tolist()
        for w, i, j in zip(word.tolist(), first, after, strict=True):
            if w not in distinct:
                distinct[w] = raw[i:j]

    buffer, size = [], 0
    for k, t in enumerate(texts):
        for part in blank_cut((t or "").encode("utf-8", "surrogatepass").translate(_LOWER)):
            buffer.append((k, part))
            size += len(part)
            if size > 1 << 21:
                flush(buffer)
                buffer, size = [], 0
    if buffer:
        flush(buffer)
    words = np.insert(np.concatenate(hashes), np.cumsum(number), _HASH_END)
    distinct[_HASH_END] = b""
    keys = np.array(list(distinct), np.int64)
    order = np.argsort(keys)
    codes = [*ids_of.of(list(distinct.values())[:-1]), np.uint32(0).tobytes()]
    sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
    place = order[np.searchsorted(keys[order], words)].astype(np.int32)
    return Words(keys, place, sizes, np.frombuffer(b"".join(codes), "<u4"), number + 1)


def cut(texts: list[str | None], ids_of: WordIds) -> Cut:
    """Whole texts, lower-cased, as words and symbols."""
    return words_of(texts, ids_of).cut()


def groups(texts: list[str | None], size: int = 1_000_000, most: int = 1000) -> Iterator[slice]:
    """Slices of ``most`` texts or about ``size`` characters."""
    at = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= size or k + 1 - at >= most:
            yield slice(at, k + 1)
            at, held = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on in the fewest bytes that hold them all, behind how many bytes these are."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + x.astype(kind.newbyteorder("<")).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def tokenised(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``docs``: row, doc_id, learns, text. The words of all texts, one row for each group of texts: what is tokenised once is counted, learned and scored."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = word_ids(tokenizer or default_tokenizer(), REMEMBERED)
        for batch in batches:
            texts = list(batch["text"])
            for which in groups(texts):
                part, found = batch.iloc[which], words_of(texts[which], ids_of)
                yield pd.DataFrame({
                    "row": [part["row"].to_numpy("<i8").tobytes()], "doc_id": [part["doc_id"].to_numpy("<i8").tobytes()],
                    "named": [part["named"].to_numpy(bool).tobytes()], "learns": [part["learns"].to_numpy(bool).tobytes()],
                    "keys": [found.keys.tobytes()], "place": [_packed(found.place)], "sizes": [_packed(found.sizes)], "ids": [_packed(found.ids)], "texts": [_packed(found.texts)],
                })

    ids = F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNotNull().alias("named")
    return materialise(docs.select("row", *ids, F.coalesce("learns", F.lit(False)).alias("learns"), "text").mapInPandas(scan, TOKENISED), "lm-words")


def _words_in(held: pd.DataFrame) -> Iterator[tuple[Words, np.ndarray, pd.DataFrame]]:
    """Of each group: its words, which of its texts are learned from, and row and doc_id of each text."""
    for r in held.itertuples():
        words = Words(np.frombuffer(r.keys, np.int64), *(_unpacked(x) for x in (r.place, r.sizes, r.ids, r.texts)))
        doc_id = pd.arrays.IntegerArray(np.frombuffer(r.doc_id, "<i8").astype(np.int64), ~np.frombuffer(r.named, bool))
        yield words, np.frombuffer(r.learns, bool), pd.DataFrame({"row": np.frombuffer(r.row, "<i8"), "doc_id": doc_id})


def counts(words: DataFrame) -> DataFrame:
    """kind (0: word, 1: symbol), key, n, first (a word's first symbol) over the texts of ``words`` (``tokenised``) that are learned from; the end mark counts in both."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c, learns, _ in _words_in(batch):
                n = np.bincount(c.place[np.repeat(learns, c.texts)], minlength=len(c.keys))
                codes, width = c.codes()
                some = np.flatnonzero(n)
                yield pd.DataFrame({"kind": np.int8(0), "key": c.keys[some], "n": n[some], "first": codes[np.cumsum(width) - width][some]})
                found = np.bincount(codes, np.repeat(n, width), SYMBOLS).astype(np.int64)
                some = np.flatnonzero(found)
                yield pd.DataFrame({"kind": np.int8(1), "key": some, "n": found[some], "first": np.int32(0)})

    found = words.mapInPandas(scan, "kind byte, key long, n long, first int")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


@dataclass(frozen=True)
class Vocabulary:
    """``of``: class of each symbol; ``inside``: log probability of each within its class; ``classes``: log probability of each class.

    ``log_words``: logarithm, by class, of the words that begin in it; ``log_free``: of the counts that discounts set free.
    """

    of: np.ndarray
    inside: np.ndarray
    classes: np.ndarray
    log_words: np.ndarray
    log_free: np.ndarray


def vocabulary(found: np.ndarray, word_n: np.ndarray, word_kinds: np.ndarray) -> Vocabulary:
    """From the count of each symbol (every one has a tenth of a count more), and of the words, and the different words, that begin with it."""
    n = found + 0.1
    order = np.argsort(-n, kind="stable")
    of = np.empty(len(n), np.int64)
    of[order[:SINGLE]] = np.arange(SINGLE)
    mass = np.cumsum(n[order[SINGLE:]])
    of[order[SINGLE:]] = SINGLE + np.minimum((mass - n[order[SINGLE:]]) / mass[-1] * SHARED, SHARED - 1).astype(np.int64)
    total = np.bincount(of, n, CLASSES)
    total[total == 0] = 0.5
    words, kinds = (np.bincount(of, x, CLASSES) for x in (word_n, word_kinds))
    words, free = np.where(words > 0, words, 1), np.where(words > 0, DISCOUNT * kinds, 1)
    return Vocabulary(of.astype(np.int16), np.log(n / total[of]).astype(np.float32), np.log(total / total.sum()).astype(np.float32), np.log(words), np.log(free))


# --- the model ---------------------------------------------------------------------------------

_SHAPES = {"e": (CLASSES, WIDTH), "p": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "a": (WIDTH, INNER), "ab": (INNER,), "b": (INNER, WIDTH), "o": (WIDTH, CLASSES), "ob": (CLASSES,)}
#: Windows are stored in this type; where there is no symbol they hold ``CLASSES``.
_CELL = np.min_scalar_type(CLASSES)
_MASK = np.where(np.tril(np.ones((WINDOW, WINDOW), bool)), 0, -1e9).astype(np.float32)
Weights = dict[str, np.ndarray]


def start(classes: np.ndarray, seed: int = 7) -> Weights:
    """Small random weights, with which every context predicts the classes' frequencies."""
    rng = np.random.default_rng(seed)
    w = {k: (rng.normal(0, 0.15, s) if k in "epqkvab" else np.zeros(s)).astype(np.float32) for k, s in _SHAPES.items()}
    return w | {"ab": np.zeros(INNER, np.float32), "ob": classes.astype(np.float32)}


def _shift(z: np.ndarray) -> None:
    """Lowers the rows whose exponentials would be too large, whatever the other rows are."""
    if z.max(initial=0) > 60:
        high = z.max(-1, keepdims=True)
        z -= np.where(high > 60, high, 0)


def _flat(a: np.ndarray) -> np.ndarray:
    return a.reshape(-1, a.shape[-1])


def _hidden(w: Weights, x: np.ndarray, first: int = 0, alike: bool = True) -> dict[str, np.ndarray]:
    """Layers at each place from ``first`` on; ``x``: windows of classes, all ``WINDOW`` long.

    ``alike``: products go window by window. A row's last bits depend on its place in a product, and equal windows are to get equal numbers
    when they are scored; while weights are learned, one product over all windows does. ``q`` is divided by the root of the width.
    """
    h = w["e"].take(x, 0)
    h += w["p"]
    late = np.ascontiguousarray(h[:, first:]) if first else h
    by = (lambda a, b: a @ b) if alike else (lambda a, b: (_flat(a) @ b).reshape(*a.shape[:-1], -1))
    each = by(h, _seen(w))
    q, k, v = each[:, first:, :WIDTH], each[..., WIDTH : 2 * WIDTH], each[..., 2 * WIDTH :]
    s = q @ k.transpose(0, 2, 1)
    s += _MASK[first:]
    _shift(s)
    np.exp(s, out=s)
    s /= np.einsum("ijk->ij", s)[..., None]
    met = s @ v
    mixed = late + met
    inner = by(mixed, w["a"])
    inner += w["ab"]
    np.maximum(inner, 0, out=inner)
    last = by(inner, w["b"])
    last += mixed
    return {"h": h, "q": q, "k": k, "v": v, "s": s, "met": _flat(met), "mixed": _flat(mixed), "inner": _flat(inner), "last": _flat(last)}


def _seen(w: Weights) -> np.ndarray:
    """Weights of q, k and v beside each other."""
    return np.concatenate([w["q"] * np.float32(1 / math.sqrt(WIDTH)), w["k"], w["v"]], axis=1)


def _with_one(last: np.ndarray) -> np.ndarray:
    """A further column of ones, which meets the bias as a further row of weights: no pass over all classes adds it."""
    out = np.ones((len(last), WIDTH + 1), np.float32)
    out[:, :WIDTH] = last
    return out


def _far(last: np.ndarray, o: np.ndarray) -> bool:
    """Whether an exponential could leave the range of its type: no product exceeds the lengths of its factors."""
    return bool(np.einsum("ij,ij->i", last, last).max(initial=0) * np.einsum("ij,ij->j", o, o).max() > 60**2)


class Descent:
    """Adam, step by step; the rate falls to a tenth over ``steps``. All weights and gradients are parts of one array each."""

    def __init__(self, w: Weights, steps: int, rate: float) -> None:
        self.all = np.concatenate([w[name].ravel() for name in _SHAPES]).astype(np.float32)
        self.slope, self.first, self.second = (np.zeros_like(self.all) for _ in range(3))
        self.w, self.g = _parts(self.all), _parts(self.slope)
        self.o, self.go = (x[-(WIDTH + 1) * CLASSES :].reshape(WIDTH + 1, CLASSES) for x in (self.all, self.slope))  # o and ob
        self.z = np.empty((0, CLASSES), np.float32)
        self.steps, self.rate, self.done = steps, rate, 0

    def step(self, rows: np.ndarray, weight: np.ndarray) -> None:
        """``rows`` of ``WINDOW + 1`` classes, negative where there is none, with their weights."""
        self.done += 1
        w, g, step = self.w, self.g, self.done
        x, y = np.maximum(rows[:, :-1], 0).astype(np.intp), rows[:, 1:].ravel()
        c = _hidden(w, x, alike=False)
        last = _with_one(c["last"])
        if len(self.z) < len(last):
            self.z = np.empty((len(last), CLASSES), np.float32)
        z = np.matmul(last, self.o, out=self.z[: len(last)])
        if _far(last, self.o):
            z -= z.max(-1, keepdims=True)
        np.exp(z, out=z)
        total = np.einsum("ij->i", z)
        real = np.where(rows[:, 1:] >= 0, weight[:, None], 0).astype(np.float32).ravel()
        real /= max(real.sum(), np.float32(1e-9))
        at = np.flatnonzero(real)
        z[at, y[at]] -= total[at]  # so far no row is divided by its total
        real /= total
        real = real[:, None]
        np.matmul((last * real).T, z, out=self.go)
        d_last = z @ w["o"].T
        d_last *= real
        d_inner = d_last @ w["b"].T
        d_inner *= c["inner"] > 0
        g["b"][:], g["a"][:], g["ab"][:] = c["inner"].T @ d_last, c["mixed"].T @ d_inner, d_inner.sum(0)
        d_mixed = d_inner @ w["a"].T
        d_mixed += d_last
        by_window = d_mixed.reshape(c["h"].shape)
        d_s = by_window @ c["v"].transpose(0, 2, 1)
        d_s -= np.einsum("ij,ij->i", d_mixed, c["met"]).reshape(*d_s.shape[:2], 1)
        d_s *= c["s"]
        d_each = np.empty((*d_mixed.shape[:1], 3 * WIDTH), np.float32)
        for k, d in enumerate((d_s @ c["k"], d_s.transpose(0, 2, 1) @ c["q"], c["s"].transpose(0, 2, 1) @ by_window)):
            d_each[:, k * WIDTH : (k + 1) * WIDTH] = _flat(d)
        g["q"][:], g["k"][:], g["v"][:] = np.split(_flat(c["h"]).T @ d_each, 3, axis=1)
        g["q"] *= np.float32(1 / math.sqrt(WIDTH))
        d_h = d_mixed
        d_h += d_each @ _seen(w).T
        g["p"][:] = by_window.sum(0)
        for k in range(WIDTH):
            g["e"][:, k] = np.bincount(x.ravel(), d_h[:, k], CLASSES)
        rate = self.rate * max(0.1, 1 - 0.9 * step / self.steps)
        self.first += np.float32(0.1) * (self.slope - self.first)
        self.second += np.float32(0.01) * (self.slope * self.slope - self.second)
        size = np.sqrt(self.second * np.float32(1 / (1 - 0.99**step)))
        size += np.float32(1e-8)
        self.all -= np.float32(rate / (1 - 0.9**step)) * self.first / size


def _parts(flat: np.ndarray) -> Weights:
    """The weights by name, as views of the array that holds all of them in the order of ``_SHAPES``."""
    ends = np.cumsum([math.prod(shape) for shape in _SHAPES.values()])
    return {name: part.reshape(shape) for (name, shape), part in zip(_SHAPES.items(), np.split(flat, ends[:-1]), strict=True)}


def descend(w: Weights, windows: np.ndarray, steps: int, seed: int, rate: float) -> Weights:
    """The weights after ``steps`` batches drawn from ``windows``."""
    rng, descent = np.random.default_rng(seed), Descent(w, steps, rate)
    for _ in range(steps):
        descent.step(windows[rng.integers(0, len(windows), BATCH)], np.ones(BATCH))
    return descent.w


def windows_of(lengths: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``WINDOW + 1`` places over texts of so many symbols, one after the other, each behind one place for its start.

    The place where each window begins, where its text ends, and from which of its steps on it is scored.
    """
    number = 1 + np.maximum(0, -(-(lengths - WINDOW) // stride))
    size = lengths + 1
    begin = np.cumsum(size) - size
    rank = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    first = np.where(rank > 0, WINDOW - stride, 0)
    return np.repeat(begin, number) + rank * stride, np.repeat(begin + size, number), first


def _laid_out(c: Cut, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts, each behind an end mark, and how many symbols each has."""
    ends = np.cumsum(c.sizes)[np.cumsum(c.texts) - 1]
    lengths = np.diff(ends, prepend=0)
    return np.insert(of[c.symbols], ends - lengths, of[END]), lengths


def _taken(classes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    at = begin[:, None] + np.arange(WINDOW + 1)
    return np.where(at < end[:, None], classes[np.minimum(at, len(classes) - 1)], -1)


def train(docs: DataFrame, vocab: Vocabulary, tokenizer: str | None = None, rounds: int = ROUNDS) -> Weights:
    """Weights from the windows of ``docs`` (text), or of those texts of a table from ``tokenised`` that are learned from."""
    spark = docs.sparkSession
    of = vocab.of
    if "text" in docs.columns:
        docs = tokenised(docs.select(F.lit(0).cast("long").alias("row"), F.lit(None).cast("long").alias("doc_id"), F.lit(True).alias("learns"), "text"), tokenizer)

    def windows_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for words, learns, _ in _words_in(batch):
                if not learns.any():
                    continue
                classes, lengths = _laid_out(words.cut(learns), of)
                taken = _taken(classes, *windows_of(lengths, WINDOW)[:2])
                raw = np.where(taken < 0, CLASSES, taken).astype(_CELL.newbyteorder("<")).tobytes()
                size = (WINDOW + 1) * _CELL.itemsize
                yield pd.DataFrame({"w": [raw[at : at + size] for at in range(0, len(raw), size)]})

    windows = docs.mapInPandas(windows_in, "w binary").groupBy("w").agg(F.count("*").alias("n"))
    rows = F.ceil(F.col("n") / COPIES)
    windows = windows.select("w", (F.col("n") / rows).alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), rows - 1)).alias("copy"))
    windows = windows.select("w", "n", F.pmod(F.hash("w", "copy"), F.lit(rounds)).alias("round"), F.xxhash64("w", "copy").alias("deal"))
    windows = materialise(windows.repartition(partitions(spark), "deal").sortWithinPartitions("round", "deal").drop("deal"), "lm-windows")
    steps = max(LEAST_STEPS, windows.count() // (rounds * partitions(spark) * BATCH))
    w = start(vocab.classes)
    for k in range(rounds):
        now = w

        def step(batches: Iterator[pd.DataFrame], now: Weights = now, k: int = k) -> Iterator[pd.DataFrame]:
            rng, descent = np.random.default_rng(k), Descent(now, steps, 0.01 * 0.5**k)
            kept, held, weight = [], 0, 0.0
            for batch in batches:
                own, n = np.frombuffer(b"".join(batch["w"]), _CELL.newbyteorder("<")).reshape(-1, WINDOW + 1).astype(np.int16), batch["n"].to_numpy()
                own[own == CLASSES] = -1
                order = rng.permutation(len(own))
                for at in range(0, len(own), BATCH):
                    descent.step(own[order[at : at + BATCH]], n[order[at : at + BATCH]])
                weight += n.sum()
                if held < LEAST_STEPS * BATCH:
                    kept.append((own, n))
                    held += len(own)
            if not held:
                return
            own, n = (np.concatenate(x) for x in zip(*kept, strict=True))
            while descent.done < LEAST_STEPS:  # few windows are trained on again
                some = rng.integers(0, len(own), BATCH)
                descent.step(own[some], n[some])
            yield pd.DataFrame({"place": np.arange(len(descent.all)), "value": descent.all.astype(np.float64), "weight": weight})

        moved = windows.where(F.col("round") == k).select("w", "n").mapInPandas(step, "place int, value double, weight double")
        mean = moved.groupBy("place").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value")).orderBy("place").toPandas()  # one row for each weight
        if len(mean):
            w = _parts(mean["value"].to_numpy(np.float32))
    return w


def log_probabilities(c: Cut, counted: np.ndarray, w: Weights, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: log probability of its class, divided by the words of the class; and what it counts in its
    class: ``counted``, its count less the discount (0 if it is not known here), and its share of the discounts. Natural logarithms.

    Every symbol of every word is scored once.
    """
    classes, lengths = _laid_out(c, vocab.of)
    begin, end, firsts = windows_of(lengths)
    first_symbol = np.cumsum(c.sizes) - c.sizes
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(len(classes), np.float32)
    o = np.concatenate([w["o"], w["ob"][None]])
    for first in (0, WINDOW - STRIDE):
        rows = np.flatnonzero(firsts == first)
        for at in range(0, len(rows), CHUNK):
            own = rows[at : at + CHUNK]
            taken = _taken(classes, begin[own], end[own])
            last = _hidden(w, np.maximum(taken[:, :-1], 0), first)["last"]
            place = (begin[own, None] + np.arange(1 + first, WINDOW + 1)).ravel()
            y = taken[:, 1 + first :].ravel()
            need = np.flatnonzero(y >= 0)
            last = _with_one(last)
            z = _flat(last.reshape(len(own), -1, WIDTH + 1) @ o)
            if _far(last, o):
                _shift(z)
            got = z[need, y[need]]
            np.exp(z, out=z)
            out[place[need]] = got - np.log(np.einsum("ij->i", z)[need])
    by_class, each = np.delete(out, starts + np.arange(len(starts))), vocab.inside[c.symbols].astype(np.float64)
    each += by_class
    each[first_symbol] -= by_class[first_symbol]
    kind = vocab.of[c.symbols[first_symbol]]
    parts = np.add.reduceat(each, first_symbol) + vocab.log_free[kind]
    with np.errstate(divide="ignore"):
        return by_class[first_symbol] - vocab.log_words[kind], np.logaddexp(np.log(counted), parts)


# --- scoring ---------------------------------------------------------------------------------------


def _scan(words: DataFrame, w: Weights, vocab: Vocabulary, head: np.ndarray, head_n: np.ndarray) -> DataFrame:
    """One row for each text of ``words`` (``tokenised``), with the words outside the head left to the join."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logs = np.log10(head_n + 1.0)
        least = np.append(head_n - DISCOUNT, 0.0)
        for batch in batches:
            for found, _, part in _words_in(batch):
                c, texts = found.cut(), len(found.texts)
                place = np.minimum(np.searchsorted(head, c.keys), max(len(head) - 1, 0))
                hit = head[place] == c.keys if len(head) else np.zeros(len(c.keys), bool)
                place, hit = place[c.place], hit[c.place]
                by_class, weight = log_probabilities(c, np.where(hit, least[place], 0.0), w, vocab)
                free = vocab.log_free[vocab.of[c.symbols[np.cumsum(c.sizes) - c.sizes]]]
                of = np.repeat(np.arange(texts), c.texts)
                own = place[hit]
                scored = np.bincount(of, by_class, texts)
                in_head = lambda x, of=of, hit=hit, n=texts: np.bincount(of[hit], x, n)
                ends = np.cumsum(np.bincount(of[~hit], minlength=texts))[:-1]
                yield pd.DataFrame({
                    "row": part["row"].to_numpy(), "doc_id": part["doc_id"].array, "n_tokens": c.texts,
                    "head_known": in_head(None).astype(np.int64), "head_sum": in_head(logs[own]),
                    "head_lm": scored + in_head(weight[hit]), "head_word": scored + in_head(np.log(least[own])),
                    "tail": np.split(c.keys[c.place[~hit]], ends), "parts": np.split(weight[~hit], ends), "free": np.split(free[~hit], ends),
                })

    return words.mapInPandas(scan, SCORED)


def head_words(words: DataFrame) -> pd.DataFrame:
    """word, n of the words above the least count, by steps of a histogram, that at most ``HEAD`` words have; in the order of words."""
    step = F.floor(F.log2("n") * FINE).cast("int")
    number = cut_at = None
    for r in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # 64 doublings at most
        number = (number or 0) + r["count"]
        if number > HEAD:
            break
        cut_at = r["step"]
    if cut_at is None:
        return pd.DataFrame({"word": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    return words.where(step >= cut_at).toPandas().sort_values("word")


def score(docs: DataFrame, learns: Column, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, word_score of each document; it learns from those with ``learns``."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), learns.alias("learns"), F.col(text).alias("text"))
    held = tokenised(own, tokenizer)
    found = materialise(counts(held), "lm-counts")
    words = found.where("kind = 0").select(F.col("key").alias("word"), "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    symbols, starts, kinds = (np.zeros(SYMBOLS) for _ in range(3))
    for r in found.where("kind = 1").select("key", "n").toPandas().itertuples():  # at most ``SYMBOLS`` rows
        symbols[r.key] = r.n
    for r in found.where("kind = 0").groupBy("first").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas().itertuples():  # the same
        starts[r.first], kinds[r.first] = r.n, r.kinds
    vocab = vocabulary(symbols, starts, kinds)
    w = train(held, vocab, tokenizer)
    head = head_words(words)
    rows = materialise(_scan(held, w, vocab, head["word"].to_numpy(np.int64), head["n"].to_numpy(np.int64)), "lm-scored")
    tail = rows.select("row", F.explode(F.arrays_zip("tail", "parts", "free")).alias("x")).select("row", F.col("x.tail").alias("word"), F.col("x.parts").alias("parts"), F.col("x.free").alias("free"))
    lm = F.when(F.col("n").isNull(), F.col("parts")).otherwise(F.log(F.col("n") - DISCOUNT + F.exp("parts")))
    alike = F.when(F.col("n").isNull(), F.col("free")).otherwise(F.log(F.col("n") - DISCOUNT))
    met = tail.join(words, "word", "left").groupBy("row").agg(F.count("n").alias("known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("sum"), F.sum(lm).alias("lm"), F.sum(alike).alias("alike"))
    rows = rows.drop("tail", "parts", "free").join(met, "row", "left")
    known = F.col("head_known") + F.coalesce("known", F.lit(0))
    base = F.col("head_sum") + F.coalesce("sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))
    lm, alike = ((F.col(f"head_{x}") + F.coalesce(y, F.lit(0.0))) / math.log(10) for x, y in (("lm", "lm"), ("word", "alike")))
    return rows.select("doc_id", "n_tokens", known.cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), lm.alias("score"), alike.alias("word_score"))
