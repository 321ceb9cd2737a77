"""Best-fit packing of token sequences by bulk-synchronous rounds.

``pieces`` tokenises whole texts and cuts only what exceeds the capacity.
``pack`` fills sequences best-fit, longest pieces first. One round places all
pieces of one length at once: pieces and open gaps are kept in sorted order, each
piece goes to the successor of its length among the gaps, pieces that want the same gap
are told apart by rank (the r-th piece gets the r-th gap, and a gap takes as many
as fit), the gaps are updated, and the next length follows.

As pieces of one length are alike, and so are sequences with one gap, a round
needs only counts by length: at most ``capacity`` classes, whatever the input's
size. The sweep over these classes gives a table of runs (length, from which rank,
sequences from, places); its size depends on the capacity, not on the input. The
pieces then find their places by their rank within their length, in one range-sorted
pass over the data. The result is exactly that of sequential best-fit decreasing.

Defined results: a null or empty text is one token, the end mark; rows that repeat an
id or a text are packed each; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._shared import _LOWER, materialise, partitions

CAPACITY = 2048
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RUNS = "length long, rank long, number long, sequence long, each long, offset long"
#: Words whose ids a worker remembers.
REMEMBERED = 700_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words of these characters split into runs of letters and of other signs, whatever surrounds them: no digits,
#: apostrophes, combining marks or special tokens.
_SIMPLE = re.compile(r'[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff!"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]+')
_RUNS = re.compile(r"[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[^a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


class WordIds:
    """Ids of texts by way of their words.

    The vocabulary's normaliser and splitter never look across ASCII white space,
    so a text's ids are those of its words, one after the other; repeated words are
    looked up. New words of plain letters and signs go to the model run by run, others through the whole tokenizer.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies write as themselves
        hidden = [x for x in range(256) if x not in visible]
        self.table = {x: chr(x) for x in visible} | {x: chr(256 + k) for k, x in enumerate(hidden)}

    def run(self, piece: str) -> bytes:
        if (out := self.runs.get(piece)) is None:
            if len(self.runs) >= self.remembered:
                self.runs.clear()
            written = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.table)
            out = self.runs[piece] = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        return out

    def learn(self, words: list[bytes]) -> None:
        if len(self.known) + len(words) > self.remembered:
            self.known.clear()
        hard = []
        for word in words:
            if _SIMPLE.fullmatch(text := word.decode()):
                self.known[word] = b"".join(map(self.run, _RUNS.findall(text.lower())))
            else:
                hard.append(word)
        for k in range(0, len(hard), 1000):
            part = hard[k : k + 1000]
            for word, out in zip(part, self.tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False), strict=True):
                self.known[word] = np.array(out.ids, "<u4").tobytes()

    def __call__(self, text: str) -> np.ndarray:
        raw = text.encode("utf-8", "replace")
        words = (raw if b"<|" in raw else raw.translate(_LOWER)).split()  # capitals could hide a special token
        return np.frombuffer(b"".join(self.of(words)), "<u4")

    def of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit numbers."""
        new = set(words).difference(self.known)
        if new and len(self.known) + len(new) > self.remembered:
            new = set(words)
        if new:
            self.learn(list(new))
        return list(map(self.known.__getitem__, words))


@lru_cache(maxsize=2)
def word_ids(path: str, remembered: int = REMEMBERED) -> WordIds:
    """One for each worker process."""
    return WordIds(path, remembered)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document.

    ``tokenizer``: path of a vocabulary file that every executor has; by default the installed word-level one.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = word_ids(tokenizer or default_tokenizer())
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(ids_of(value or ""), np.uint32(END)).astype("<u4")
                rows += [(doc_id, k, at, min(capacity, len(ids) - at), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(cut, PIECES)


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank, number, sequence, each, offset) that pack ``counts`` pieces of each length.

    A run says: the ``number`` pieces of this length from this rank on go to the sequences from
    ``sequence`` on, ``each`` to one, the first at ``offset``.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, how many)
    gaps: list[int] = []  # ascending
    used = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
            else:
                gap, first, n = capacity, used, -(-left // (capacity // length))
                used += n
            each = gap // length
            full, rest = (n, 0) if left >= n * each else divmod(left, each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - gap))
                put(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if rest:
                runs.append((length, rank, rest, first + full, each, capacity - gap))
                put(gap - rest * length, first + full, 1)
                rank, left, full = rank + rest, left - rest, full + 1
            put(gap, first + full, n - full)
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = materialise(pieces, "pack-cut")  # the range sort reads its input twice
    order = ["doc_id", "piece", "start", "ids_crc32"]
    ranged = pieces.repartitionByRange(partitions(spark), "length", *order).withColumn("__part", F.spark_partition_id())
    ranged = materialise(ranged, "pack-pieces")
    per = ranged.groupBy("__part", "length").count()
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    per = materialise(per.withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))), "pack-counts")
    totals = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most ``capacity`` rows
    runs = spark.createDataFrame(sweep(totals, capacity), RUNS)
    within = F.row_number().over(Window.partitionBy("__part", "length").orderBy(*order)) - 1
    ranked = ranged.withColumn("__row", within).join(per.drop("count"), ["__part", "length"])
    ranked = ranked.select(*pieces.columns, (F.col("__row") + F.col("__before")).alias("__rank"))
    # each length has few runs; the table's size is bounded by the capacity
    found = ranked.join(runs.withColumnRenamed("length", "__length"), (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("rank")) & (F.col("__rank") < F.col("rank") + F.col("number")))
    step = F.col("__rank") - F.col("rank")
    return found.select(*pieces.columns, (F.col("sequence") + F.expr("(__rank - rank) div each")).alias("sequence_id"), (F.col("offset") + step % F.col("each") * F.col("length")).alias("offset"))
