"""Helpers that several operators use: shared storage, let-bindings, vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder is ``spark.checkpoint.dir`` of the session; only where that is
    unset in local mode (single-machine tests) a temporary one is used. A cluster without it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="spanwright-"))
        root = _own_dir[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(id_col: str, n: int) -> Column:
    """crc32 of an id as text, modulo ``n``; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def sampled(docs: DataFrame, wanted: DataFrame, rows: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The texts of ``wanted`` (doc_id and more), a bounded table, with its columns; of repeated ids, ``rows`` rows at most in all."""
    rest = [c for c in wanted.columns if c != "doc_id"]
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = own.join(F.broadcast(wanted), "doc_id").select("doc_id", "text", *rest)
    return found.orderBy(F.xxhash64("doc_id"), F.xxhash64("text"), *rest).limit(rows)


def blank_cut(raw: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """Parts of a text of about ``size`` bytes, cut at blanks only."""
    at = 0
    while len(raw) - at > size:
        end = max(raw.rfind(b, at, at + size) for b in (b" ", b"\n", b"\t"))
        if end <= at:
            end = min((x for x in (raw.find(b, at + size) for b in (b" ", b"\n", b"\t")) if x >= 0), default=len(raw))
        yield raw[at:end]
        at = end
    yield raw[at:]


# --- word and shingle hashes over UTF-8 bytes, vectorised -------------------------------------

_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers, modulo 2**64, of the hash base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, base in enumerate((_ODD, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Cumulated polynomial of the bytes; entry i covers the bytes before i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash, the start and the end of each word of a text, in order."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(solid))
    start, end = edge[::2], edge[1::2]
    sums = prefix_sums(data)
    inverse = powers(len(data) + 1)[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)), start, end


def word_hashes(text: bytes) -> np.ndarray:
    """One 64-bit hash for each word of a text, in order."""
    return word_places(text)[0]


def shingle_hashes(text: str | None, width: int, lower: bool = True) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; of the whole sequence if there are fewer words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = word_hashes(raw.translate(_LOWER) if lower else raw)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out * _ODD + words[k : k + n] + np.uint64(k + 1))
    return np.unique(out)
