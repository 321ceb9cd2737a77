"""Legacy archive converter: ARC files of versions 1 and 2 become equivalent WARC files.

An ARC file is a chain of records: one header line, whose fields depend on the
version that the first record (``filedesc://``) declares, then as many bytes as
the line's last field says, then a line feed. The converter walks the chain by
the declared lengths and synthesises for each record a WARC record: an
identifier derived from the content, the date in ISO form, the type (warcinfo,
response or resource; revisit for repeated payloads), and digests of block and payload.

Archives are written by Spark's text writer, whose line separator is the
format's record trailer, so they go to any store that Spark writes; they are read
as ``binaryFile``. A file holds ``BYTES`` of records at most (a larger record has a file of
its own) and begins with the block that declares its version; it becomes one WARC file,
whose warcinfo record is that block. A record's payload
never meets another's: repeated payloads are found on (digest, page_id) alone and
the verdicts go back to the archive they concern.

Defined results: a null payload counts as empty; a null page_id is kept and never
stands for others; of rows that repeat the smallest page_id all are responses; a
null url becomes ``urn:page:<id>``; an empty table gives no records; other columns
are ignored. A header line that no version allows, or a declared length beyond the
file's end, raises ``ValueError`` naming the file and the offset.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialise, shared_dir

#: Bytes of the records of one archive file, at most, where it has several.
BYTES = 32 << 20
#: Payloads below this size are never revisits.
LEAST = 100
#: The header lines that the two versions declare.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
SPACE = uuid.UUID("6f1f5ab2-6c0d-5f0e-9c39-5b6a3f0a7d11")
#: A field of our own, beside the record id, for the page that a revisit repeats.
REFERS_TO_PAGE = "X-Refers-To-Page"
INDEX = "path string, record int, page_id long, payload_bytes long, payload_digest string, record_id string"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


# --- the formats ------------------------------------------------------------------------------


def unpack(content: bytes) -> bytes:
    """The content, decompressed if gzip, in one or many members."""
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def version_block(name: str, version: int) -> bytes:
    """The first record of an ARC file, without its trailer."""
    block = f"{version} 0 spanwright\n{ARC_FIELDS[version]}\n"
    between = f"200 - - 0 {name} " if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 20200101000000 text/plain {between}{len(block)}\n{block}".encode()


def arc_records(content: bytes, name: str = "", whole: bool = False) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record after the version block; of that too, if ``whole``."""
    data, at, fields = unpack(content), 0, None
    while at < len(data):
        if data[at : at + 1] in b"\r\n":  # the trailer of the record before
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        length = int(line[-1]) if line[-1].isdigit() else -1
        stop = end + 1 + length
        if end < 0 or length < 0 or stop > len(data):
            raise ValueError(f"{name}: no ARC record at byte {at}")
        block = data[end + 1 : stop]
        if line[0].startswith("filedesc://"):
            version = block.split(b" ", 1)[0]
            if version not in (b"1", b"2"):
                raise ValueError(f"{name}: unknown ARC version at byte {at}")
            fields = ARC_FIELDS[int(version)].split(" ")
            if whole:
                yield dict(zip(("URL", "IP-address", "Archive-date", "Content-type"), line, strict=False)), block
        else:
            fields = fields or ARC_FIELDS[1 if len(line) == 5 else 2].split(" ")
            if len(line) != len(fields):
                raise ValueError(f"{name}: {len(line)} fields instead of {len(fields)} at byte {at}")
            yield dict(zip(fields, line, strict=True)), block
        at = stop


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload; a block without HTTP header is all payload."""
    if block.startswith(b"HTTP/"):
        head, sep, rest = block.partition(b"\r\n\r\n")
        if sep:
            return head + sep, rest
    return b"", block


def page_id_of(head: bytes) -> int | None:
    found = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
    return int(found[1]) if found else None


def record_id(fields: dict[str, str], head: bytes, digest: str) -> str:
    """An identifier that follows from a record's address, time, page and payload; rows that repeat a page share it."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, '|'.join((fields['URL'], (fields['Archive-date'] + '0' * 14)[:14], digest, str(page_id_of(head)))))}>"


def iso_date(date: str) -> str:
    date = (date + "0" * 14)[:14]
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:]}Z"


def warcinfo(fields: dict[str, str], block: bytes) -> bytes:
    """The WARC record of a version block, without the trailer."""
    name, digest = fields["URL"].removeprefix("filedesc://"), hashlib.sha256(block).hexdigest()
    out = [
        "WARC/1.1", "WARC-Type: warcinfo", f"WARC-Date: {iso_date(fields['Archive-date'])}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE, f'{name}|{digest}')}>",
        f"WARC-Filename: {name}", f"WARC-Block-Digest: sha256:{digest}", f"Content-Type: {fields['Content-type']}", f"Content-Length: {len(block)}", "", "",
    ]
    return "\r\n".join(out).encode("utf-8", "surrogateescape") + block


def warc_record(fields: dict[str, str], block: bytes, refers_to: tuple[int, str] | None = None) -> bytes:
    """The WARC record of an ARC record, without the trailer; ``refers_to``: page and record id of the response that it repeats."""
    head, payload = http_parts(block)
    kind = "response" if head else "resource"
    digest = hashlib.sha256(payload).hexdigest()
    if refers_to is not None:
        kind, block = "revisit", head
    out = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {fields['URL']}", f"WARC-Date: {iso_date(fields['Archive-date'])}",
        f"WARC-Record-ID: {record_id(fields, head, digest)}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if fields["IP-address"] not in ("-", "0.0.0.0"):
        out.append(f"WARC-IP-Address: {fields['IP-address']}")
    if refers_to is not None:
        out += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to[1]}", f"{REFERS_TO_PAGE}: {refers_to[0]}"]
    out += [f"Content-Type: {'application/http; msgtype=response' if head else fields['Content-type']}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(out).encode("utf-8", "surrogateescape") + block


def warc_records(content: bytes, name: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of each record."""
    data, at = unpack(content), 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : max(end, at)].decode("utf-8", "surrogateescape").split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        length = int(fields.get("Content-Length", -1))
        if end < 0 or not lines[0].startswith("WARC/") or length < 0 or end + 4 + length > len(data):
            raise ValueError(f"{name}: no WARC record at byte {at}")
        yield fields, data[end + 4 : end + 4 + length]
        at = end + 4 + length


# --- on Spark ---------------------------------------------------------------------------------


def write_archives(archives: DataFrame, path: str, trailer: str) -> None:
    """Writes each row of ``archive`` (binary) as a file; ``trailer`` ends its last record."""
    lines = archives.select(F.col("archive").cast("string").alias("value"))
    lines.write.option("lineSep", trailer).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def gather(records: DataFrame, begin: Callable[[str], bytes], trailer: bytes, most: int) -> DataFrame:
    """``record`` (binary) put together as ``archive``s of ``most`` bytes; each begins with ``begin`` of its name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        size = number = 0
        closed = lambda: pd.DataFrame({"archive": [trailer.join([begin(f"pages-{TaskContext.get().partitionId()}-{number}.arc"), *held])]})
        for batch in batches:
            for record in batch["record"]:
                if held and size + len(record) > most:
                    yield closed()
                    held, size, number = [], 0, number + 1
                held.append(record)
                size += len(record)
        if held:
            yield closed()

    return records.mapInPandas(run, "archive binary")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of each archive file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, version: int = 1, most: int = BYTES) -> None:
    """Writes ``pages`` (page_id, url, html) as ARC files: HTTP responses that carry the page's number."""
    html, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.regexp_replace("url", r"\s", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("-"))))
    mark = F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), mark, F.lit("Content-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(head, html)
    between: list[Column] = [] if version == 1 else [F.lit(x) for x in ("200", "-", "-", "0", "pages.arc")]
    line = F.concat_ws(" ", url, F.lit("0.0.0.0"), F.lit("20200101000000"), F.lit("text/html"), *between, F.octet_length(block).cast("string"))
    records = pages.select(F.concat(line, F.lit("\n"), block).cast("binary").alias("record"))
    write_archives(gather(records, lambda name: version_block(name, version), b"\n", most), path, "\n")


def index_arc(files: DataFrame) -> DataFrame:
    """path, record number, page_id, size and digest of the payload of each record of ARC ``files``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for k, (fields, block) in enumerate(arc_records(content, path)):
                    head, payload = http_parts(block)
                    digest = hashlib.sha256(payload).hexdigest()
                    rows.append((path, k, page_id_of(head), len(payload), digest, record_id(fields, head, digest)))
                yield pd.DataFrame(rows, columns=["path", "record", "page_id", "payload_bytes", "payload_digest", "record_id"]).astype({"page_id": "Int64"})

    return files.mapInPandas(read, INDEX)


def revisits(index: DataFrame) -> DataFrame:
    """path, revisits (record number -> page and record id of the response): the records that repeat an earlier page's payload."""
    large = index.where((F.col("payload_bytes") >= LEAST) & F.col("page_id").isNotNull())
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.min(F.struct("page_id", "record_id"))["record_id"].alias("response")).where("first < last")
    later = large.drop("record_id").join(first, "payload_digest").where("page_id > first")
    return later.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("record", F.struct("first", "response")))).alias("revisits"))


def _target(found) -> tuple[int, str] | None:
    return None if found is None else (found["first"], found["response"])


def convert(files: DataFrame, revisits: DataFrame) -> DataFrame:
    """The WARC file of each of the ARC ``files``, as ``archive`` binary."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content, again in zip(batch["path"], batch["content"], batch["revisits"], strict=True):
                again = dict(again) if again is not None else {}
                out, k = [], 0
                for fields, block in arc_records(content, path, whole=True):
                    if fields["URL"].startswith("filedesc://"):
                        out.append(warcinfo(fields, block))
                    else:
                        out.append(warc_record(fields, block, _target(again.get(k))))
                        k += 1
                if out:
                    yield pd.DataFrame({"archive": [b"\r\n\r\n".join(out)]})

    return files.join(revisits, "path", "left").select("path", "content", "revisits").mapInPandas(rewrite, "archive binary")


def read_warc(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each response and revisit; digests are verified."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for fields, block in warc_records(content, path):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    head, payload = http_parts(block)
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    size, refers = len(payload), None
                    if kind == "revisit":
                        size = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", head)[1])
                        refers = int(fields[REFERS_TO_PAGE])
                    elif hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: payload of {fields['WARC-Record-ID']} does not have its digest")
                    rows.append((page_id_of(head), size, digest, kind, refers))
                yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return files.mapInPandas(read, RESULT)


def arc_to_warc(spark: SparkSession, arc: str, warc: str) -> None:
    """Converts the ARC files under ``arc`` to WARC files under ``warc``."""
    files = read_files(spark, arc)
    index = materialise(index_arc(files), "arc-index")
    write_archives(convert(files, revisits(index)), warc, "\r\n\r\n")


def round_trip(pages: DataFrame, version: int = 1) -> DataFrame:
    """Archives ``pages`` in the legacy format, converts them, and reads the WARC files back."""
    spark = pages.sparkSession
    arc, warc = shared_dir(spark, "arc"), shared_dir(spark, "warc")
    write_arc(pages, arc, version)
    arc_to_warc(spark, arc, warc)
    return read_warc(read_files(spark, warc))
