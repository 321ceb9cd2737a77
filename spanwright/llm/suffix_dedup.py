"""Removal of byte strings of 200 bytes that start more than once in the corpus, by sharded suffix arrays.

1. Anchors deal windows to shards. Every 200-byte window has one anchor, the 48-gram with the
   smallest hash in it, so equal windows have equal anchors at equal places. Consecutive
   windows with one anchor are one context (``anchors``).
2. Contexts whose anchor occurs once hold no repeated window. Contexts of one anchor that are
   all equal hold nothing but repeated windows. Both need no sort (``repeated``).
3. The distinct contexts of all other anchors go to shards by anchor. Each shard is sorted by
   ``suffix_array``; the common prefixes of neighbours tell which windows occur again (``sort_shards``).
   An anchor whose contexts have more than ``SHARD`` bytes is hot: its windows are counted instead (``count_windows``).
   Windows of ``BLOCK`` neighbouring anchor offsets have the bytes between the last start and the
   first end in common; where no other context has these, none of the windows recurs. The rest are
   counted by 128-bit hashes, so that no task holds all contexts of an anchor.
4. Verdicts go back to the documents, which lose the bytes that repeated windows cover.

What is shuffled is a row for every 70 bytes or so, then only the texts that a verdict concerns.
A context is at most 352 bytes; a shard holds about ``SHARD`` bytes.

Defined results: a null text is empty; texts below 200 bytes stay; rows that repeat a document are
copies of each other, so what has 200 bytes goes from all of them; an empty table gives an empty table;
other columns are kept by ``remove_repeats``. Cutting bytes can split a character; ``remove_repeats``
drops the fragments at the seams, the query counts bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from ._shared import materialise, mix, powers, prefix_sums
from .suffix_array import common_prefix_reaches, suffix_array

LENGTH, GRAM = 200, 48
#: Bytes of one shard, about, and of one buffer of texts.
SHARD, BUFFER = 2_000_000, 750_000
#: Anchor offsets whose windows are ruled out together, and parts into which equal keys of a join are dealt.
BLOCK, SALTS = 16, 64
CONTEXTS = "row long, start int, windows int, anchor long, context long"
VERDICTS = "anchor long, context long, first int, number int"
_PLACE = np.uint64((1 << 24) - 1)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], forth[width - 1 : n])


def _contexts(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """start, windows, anchor hash and context hash of the runs of windows with one anchor, where ``valid`` windows start."""
    sums = prefix_sums(data)
    inverse = powers(len(data) + 1)[1]
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(data) - GRAM + 1])
    keyed = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    place = (_sliding_least(keyed, LENGTH - GRAM + 1) & _PLACE).astype(np.int64)
    place = np.where(valid[: len(place)], place, -1)
    edge = np.flatnonzero(np.diff(place, prepend=-2))
    start, stop = edge, np.append(edge[1:], len(place))
    real = place[start] >= 0
    start, stop = start[real], stop[real]
    at = place[start]
    end = stop - 1 + LENGTH
    shape = ((at - start) * 512 + (stop - start)).astype(np.uint64)
    context = mix(mix((sums[end] - sums[start]) * inverse[start]) + mix(shape))
    return start, stop - start, gram[at].view(np.int64), context.view(np.int64)


def anchors(docs: DataFrame) -> DataFrame:
    """The contexts of all texts; ``docs``: row, text."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(parts: list[tuple[int, int, bytes]]) -> pd.DataFrame:
            data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
            sizes = np.array([len(p[2]) for p in parts])
            begin = np.cumsum(sizes) - sizes
            valid = np.ones(len(data), bool)
            for b, s in zip(begin + sizes, sizes, strict=True):
                valid[b - min(LENGTH - 1, s) : b] = False
            start, windows, anchor, context = _contexts(data, valid)
            of = np.searchsorted(begin, start, "right") - 1
            row, offset = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
            return pd.DataFrame({"row": row[of], "start": (start - begin[of] + offset[of]).astype(np.int32), "windows": windows.astype(np.int32), "anchor": anchor, "context": context})

        parts, size = [], 0
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if len(raw) < LENGTH:
                    continue
                # a longer text goes on, with the windows that start in the next part
                for at in range(0, len(raw) - LENGTH + 1, BUFFER):
                    parts.append((row, at, raw[at : at + BUFFER + LENGTH - 1]))
                    size += len(parts[-1][2])
                    if size >= BUFFER:
                        yield flush(parts)
                        parts, size = [], 0
        if parts:
            yield flush(parts)

    return docs.mapInPandas(scan, CONTEXTS)


def repeated(contexts: DataFrame) -> DataFrame:
    """The contexts whose anchor occurs again, with ``mixed``: whether its contexts differ."""
    seen = contexts.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).where("n > 1")
    return contexts.join(seen.select("anchor", (F.col("low") < F.col("high")).alias("mixed")), "anchor")


def _pack(text: pd.Series) -> list[bytes]:
    squeeze = zstandard.ZstdCompressor(level=1)
    return [squeeze.compress((t or "").encode("utf-8", "surrogatepass")) for t in text]


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` (row, text and more) with the text compressed, for shuffling."""
    rest = [c for c in docs.columns if c != "text"]
    schema = docs.select(*rest, F.lit(b"").alias("packed")).schema

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[rest].assign(packed=_pack(batch["text"]))

    return docs.select(*rest, "text").mapInPandas(squeeze, schema)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Start and length of the runs of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(int(x), int(y - x)) for x, y in zip(edge[::2], edge[1::2], strict=True)]


def _again(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys occur more than once; rows of one key are dealt by their context."""
    rows = rows.withColumn("salt", F.pmod("context", F.lit(SALTS)))
    seen = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.collect_set("salt").alias("salts")).where("n > 1")
    return rows.join(seen.select(*keys, F.explode("salts").alias("salt")), [*keys, "salt"], "left_semi").drop("salt")


def anchor_place(raw: bytes) -> int:
    """Where the anchor of a context's windows begins in the context."""
    data = np.frombuffer(raw[:LENGTH], np.uint8)
    sums = prefix_sums(data)
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * powers(len(data) + 1)[1][: len(data) - GRAM + 1])
    return int((gram & ~_PLACE).argmin())


def count_windows(cuts: DataFrame) -> DataFrame:
    """anchor, context, first, number like ``sort_shards``, of the contexts in ``cuts`` (anchor, context, again, bytes)."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, c, raw in zip(batch["anchor"], batch["context"], batch["bytes"], strict=True):
                at, last = anchor_place(raw), len(raw) - LENGTH
                for b in range((at - last) // BLOCK, at // BLOCK + 1):
                    low, high = b * BLOCK, min(b * BLOCK + BLOCK - 1, LENGTH - GRAM)
                    core = xxhash.xxh3_64_intdigest(raw[at - low : at + LENGTH - high])
                    out.append((a, c, b, core - (1 << 63), max(at - high, 0), min(at - low, last) + 1))
            yield pd.DataFrame(out, columns=["anchor", "context", "block", "core", "begin", "end"])

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, c, raw, some in zip(batch["anchor"], batch["context"], batch["bytes"], batch["some"], strict=True):
                out += [(a, c, k, xxhash.xxh3_128_digest(raw[k : k + LENGTH])) for s in some for k in range(s["begin"], s["end"])]
            yield pd.DataFrame(out, columns=["anchor", "context", "place", "window"])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, c, places in zip(batch["anchor"], batch["context"], batch["places"], strict=True):
                flags = np.zeros(LENGTH, bool)
                flags[places] = True
                out += [(a, c, *run) for run in _runs(flags)]
            yield pd.DataFrame(out, columns=["anchor", "context", "first", "number"])

    parts = materialise(cuts.select("anchor", "context", "bytes").mapInPandas(blocks, "anchor long, context long, block int, core long, begin int, end int"), "suffix-blocks")
    left = _again(parts, "anchor", "block", "core").groupBy("anchor", "context").agg(F.collect_list(F.struct("begin", "end")).alias("some"))
    each = cuts.join(left, ["anchor", "context"]).select("anchor", "context", "bytes", "some")
    each = materialise(each.mapInPandas(windows, "anchor long, context long, place int, window binary"), "suffix-windows")
    places = _again(each, "window").groupBy("anchor", "context").agg(F.collect_list("place").alias("places"))
    runs = places.join(cuts.where("again").select("anchor", "context"), ["anchor", "context"], "left_anti").mapInPandas(joined, VERDICTS)
    whole = cuts.where("again").select("anchor", "context", F.lit(0).alias("first"), (F.length("bytes") - LENGTH + 1).alias("number"))
    return runs.unionByName(whole)


def hot_anchors(one: DataFrame) -> DataFrame:
    """The anchors whose distinct contexts have more bytes than a shard."""
    return one.groupBy("anchor").agg(F.sum(F.col("windows") + LENGTH).alias("bytes")).where(F.col("bytes") > SHARD).select("anchor", F.lit(True).alias("hot"))


def sort_shards(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """anchor, context, first, number: runs of repeated windows in the mixed contexts.

    One occurrence stands for all equal contexts; ``copies`` says whether there are more.
    """
    one = mixed.groupBy("anchor", "context").agg(F.min(F.struct("row", "start", "windows")).alias("o"), F.count("*").alias("copies"))
    one = materialise(one.select("anchor", "context", "o.*", "copies"), "suffix-contexts")
    hot = materialise(hot_anchors(one), "suffix-hot")
    some_hot = bool(hot.head(1))
    # there is at most one hot anchor for each ``SHARD`` bytes
    one = one.join(F.broadcast(hot), "anchor", "left") if some_hot else one.withColumn("hot", F.lit(None).cast("boolean"))
    one = one.withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = one.groupBy("row").agg(F.collect_list(F.struct("start", "windows", "anchor", "context", "copies", "hot")).alias("spans"))
    total = one.agg(F.sum(F.col("windows") + LENGTH)).head()[0] or 0
    texts = docs.join(wanted, "row")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, spans in zip(batch["packed"], batch["spans"], strict=True):
                raw = _unpack(text)
                yield pd.DataFrame([(s["anchor"], s["context"], s["copies"] > 1, s["hot"], raw[s["start"] : s["start"] + s["windows"] + LENGTH - 1]) for s in spans], columns=["anchor", "context", "again", "hot", "bytes"])

    cuts = texts.select("packed", "spans").mapInPandas(cut, "anchor long, context long, again boolean, hot boolean, bytes binary")
    if some_hot:
        cuts = materialise(cuts, "suffix-cuts")
        counted = count_windows(materialise(cuts.where("hot").dropDuplicates(["anchor", "context"]), "suffix-hot-cuts"))
        cuts = cuts.where("not hot")
    # rows that repeat a document gave the same occurrence
    cuts = cuts.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-int(total) // SHARD))))).dropDuplicates(["shard", "anchor", "context"])

    def sort(part: pd.DataFrame) -> pd.DataFrame:
        strings = list(part["bytes"])
        sizes = np.array([len(s) for s in strings])
        data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        begin = np.cumsum(sizes + 1) - sizes - 1
        symbols = data.astype(np.int64) + 1
        symbols[begin + sizes] = 0
        room = np.repeat(begin + sizes, sizes + 1) - np.arange(len(data))
        flags = common_prefix_reaches(data, suffix_array(symbols, LENGTH), room, LENGTH)
        rows = []
        for a, c, again, b, s in zip(part["anchor"], part["context"], part["again"], begin, sizes, strict=True):
            n = s - LENGTH + 1
            rows += [(a, c, *run) for run in _runs(flags[b : b + n] | again)]
        return pd.DataFrame(rows, columns=["anchor", "context", "first", "number"])

    found = cuts.groupBy("shard").applyInPandas(sort, VERDICTS)
    return found.unionByName(counted) if some_hot else found


def spans(docs: DataFrame) -> DataFrame:
    """row, spans: start and number of the repeated windows of each text that has some; ``docs``: row, text."""
    contexts = materialise(anchors(docs.select("row", "text")), "suffix-anchors")
    hits = materialise(repeated(contexts), "suffix-repeated")
    mixed = hits.where("mixed")
    verdict = materialise(sort_shards(packed(docs.select("row", "text")), mixed), "suffix-verdicts")
    sorted_ = mixed.join(verdict, ["anchor", "context"]).select("row", (F.col("start") + F.col("first")).alias("start"), "number")
    plain = hits.where("not mixed").select("row", "start", F.col("windows").alias("number"))
    return plain.union(sorted_).groupBy("row").agg(F.collect_list(F.struct("start", "number")).alias("spans"))


def kept_bytes(raw: bytes, spans) -> tuple[list[bytes], int, int]:
    """The parts of ``raw`` that no repeated window covers, the number of bytes removed and of runs removed."""
    cover = sorted((s["start"], s["start"] + s["number"] + LENGTH - 1) for s in spans)
    parts, at, removed, runs, end = [], 0, 0, 0, -1
    for a, b in cover:
        if a > end:  # not touching the run before
            if end >= 0:
                removed += end - at
                at = end
            parts.append(raw[at:a])
            at, runs, end = a, runs + 1, b
        else:
            end = max(end, b)
    if runs:
        removed += end - at
        at = end
    parts.append(raw[at:])
    return parts, removed, runs


def numbered(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.withColumn("row", F.xxhash64(id_col, text))


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    rows = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")))
    found = packed(rows).join(spans(rows), "row", "left").select("doc_id", "packed", "spans")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, own in zip(batch["doc_id"], batch["packed"], batch["spans"], strict=True):
                raw = _unpack(text)
                parts, removed, runs = kept_bytes(raw, own if own is not None else [])
                out.append((doc_id, len(raw), removed, runs, hashlib.sha256(b"".join(parts)).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    return found.mapInPandas(count, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@F.pandas_udf(BinaryType())
def _squeezed(text: pd.Series) -> pd.Series:
    squeeze = zstandard.ZstdCompressor(level=1)
    return text.map(lambda t: None if t is None else squeeze.compress(t.encode("utf-8", "surrogatepass")))


@F.pandas_udf(StringType())
def _without(packed: pd.Series, spans: pd.Series) -> pd.Series:
    """The texts without what their spans cover; a null stays null."""

    def one(text: bytes | None, own) -> str | None:
        if text is None:
            return None
        raw = _unpack(text)
        return raw.decode("utf-8", "surrogatepass") if own is None else b"".join(kept_bytes(raw, own)[0]).decode("utf-8", "ignore")

    return pd.Series([one(*x) for x in zip(packed, spans, strict=True)], dtype=object)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes gone from ``text``; all rows and columns stay, a null text stays null.

    Each document is shuffled once, with its text compressed.
    """
    rest = [c for c in docs.columns if c != "text"]
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("doc"), F.col("text"), F.xxhash64("doc_id", "text").alias("row"))
    found = materialise(spans(row.select("row", "text")), "suffix-spans")
    joined = row.select("doc", "row", _squeezed("text").alias("packed")).join(found, "row", "left")
    cut = joined.select("doc", _without("packed", "spans").alias("text"))
    return cut.select(*(F.col(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns))
