"""Legacy archive converter: ARC records become WARC records, written and read through Spark.

An ARC record is a header line, whose fields depend on the version, and as many
bytes as the line declares::

    version 1: URL IP date type length
    version 2: URL IP date type result checksum location offset filename length

``parse_arc`` walks such records by their declared lengths; the version is that of the
``filedesc`` record an archive begins with, or is given.  ``to_warc`` makes the
WARC fields they lack: a record id (name-based UUID), an ISO timestamp from the 14
digits, the record type (filedesc: warcinfo, repeated payloads: revisit, others:
response) and base32 SHA-1 digests.  Of records with equal payloads of at least
``min_bytes`` bytes, that with the largest page_id is a response; those with a
smaller page_id are revisits of it and carry no payload.

Each record is one gzip member, and a file ends with the record that brings it to ``FILE_BYTES``
(compressed); readers go from member to member and by declared lengths, never by the end
mark.  Files get their names when all of them are written.  Bodies do not leave the task that reads them unless the table of
revisits (page_id, digest, page_id) is too large for Spark to broadcast, whose size it knows, for it is written first.

Defined results: null html is an empty payload, null url is written as ``-``; spaces
and control characters in URLs are percent-encoded; rows with a null page_id are
responses; repeated rows are all written, and those that share the largest page_id
are all responses; an empty table gives an empty result; other columns are ignored.
A task holds one record, and the compressed bytes of one file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm._shared import shared_path, stash
from varve.sources.file_sink import write_files

#: Fields of the header lines of the two ARC versions.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
END = "\r\n\r\n"
#: Compressed bytes after which a file ends, and bytes decompressed at once.
FILE_BYTES, CHUNK = 16 << 20, 1 << 16
_ODD = re.compile(r"[\x00-\x20\x7f]")


@dataclass(frozen=True)
class ArcRecord:
    version: int
    url: str
    ip: str
    date: str
    type: str
    payload: bytes


def write_arc(record: ArcRecord, filename: str = "-", offset: int = 0) -> bytes:
    """One ARC record in the layout of its version."""
    url = _ODD.sub(lambda m: f"%{ord(m[0]):02X}", record.url) or "-"
    values = {
        "url": url, "ip": record.ip, "date": record.date, "type": record.type, "result": "200", "checksum": "-", "location": "-",
        "offset": str(offset), "filename": filename, "length": str(len(record.payload)),
    }
    return " ".join(values[f] for f in ARC_FIELDS[record.version]).encode() + b"\n" + record.payload + b"\n"


def arc_version(data: bytes) -> int:
    """The version that an archive's first record, its file description, states."""
    line, _, rest = data.partition(b"\n")
    if not line.startswith(b"filedesc:"):
        raise ValueError("not an ARC archive: it does not begin with a file description")
    stated = rest.split(b" ", 1)[0].strip()
    if not stated.isdigit() or int(stated) not in ARC_FIELDS:
        raise ValueError(f"unknown ARC version {stated[:20]!r}")
    return int(stated)


def write_filedesc(version: int, date: str, name: str) -> bytes:
    """The record with which an ARC archive begins."""
    fields = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    body = f"{version} 0 varve\n{fields[version]}\n".encode()
    return write_arc(ArcRecord(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", body), name)


def parse_arc(data: bytes, version: int | None = None) -> Iterator[ArcRecord]:
    """The records of an ARC archive, by their declared lengths."""
    at = 0
    if version is None and data:
        version = arc_version(data)
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header line without an end at byte {at}")
        # The URL comes first and may hold spaces in old archives, so fields are taken from the right.
        fields = data[at:end].decode("utf-8", "surrogateescape").rsplit(" ", len(ARC_FIELDS[version]) - 1)
        if len(fields) != len(ARC_FIELDS[version]) or not fields[-1].isdigit():
            raise ValueError(f"not an ARC version {version} header line at byte {at}")
        of = dict(zip(ARC_FIELDS[version], fields, strict=True))
        begin, stop = end + 1, end + 1 + int(of["length"])
        if stop > len(data):
            raise ValueError(f"ARC record at byte {at} is cut short")
        yield ArcRecord(version, of["url"], of["ip"], of["date"], of["type"], data[begin:stop])
        at = stop
        while data[at : at + 1] == b"\n":
            at += 1


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key} {payload_digest}')}>"


def to_warc(record: ArcRecord, page_id: int | None, refers_to: int | None = None) -> bytes:
    """The WARC record of an ARC record, without its end mark; with ``refers_to`` a revisit of that page."""
    sha = digest(record.payload)
    kind = "warcinfo" if record.url.startswith("filedesc:") else "response" if refers_to is None else "revisit"
    d = record.date.ljust(14, "0")
    block = b"" if kind == "revisit" else record.payload
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(f"page:{page_id}", sha)),
        ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"),
        ("WARC-Target-URI", record.url),
        ("WARC-IP-Address", record.ip),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", record.type),
        ("X-Payload-Length", str(len(record.payload))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(f"page:{refers_to}", sha)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    fields.append(("Content-Length", str(len(block))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "surrogateescape") + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an uncompressed WARC archive, by declared lengths."""
    at, end = 0, END.encode()
    while at < len(data):
        stop = data.find(end, at)
        lines = data[at:stop].decode("utf-8", "surrogateescape").split("\r\n")
        if stop < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        begin = stop + len(end)
        at = begin + int(fields["Content-Length"])
        if data[at : at + len(end)] != end:
            raise ValueError(f"WARC record without an end mark at byte {at}")
        yield fields, data[begin:at]
        at += len(end)


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one after another."""
    view, at = memoryview(data), 0
    while at < len(view):
        reader, out = zlib.decompressobj(31), []
        while not reader.eof:
            if at >= len(view):
                raise ValueError("gzip member is cut short")
            part = view[at : at + CHUNK]
            out.append(reader.decompress(part))
            at += len(part) - len(reader.unused_data)
        yield b"".join(out)


def find_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of the pages that revisit another; html does not leave its task."""
    ids = pages.select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).where(F.octet_length("payload") >= min_bytes).select("page_id", F.sha1("payload").alias("sha"))
    shared = ids.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared, _ = stash(shared, "payloads")  # an aggregate that is joined directly would keep Spark from splitting a frequent payload
    return ids.join(shared, "sha").where(F.col("page_id") < F.col("refers_to")).select("page_id", "sha", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, date: str = "20240101000000", min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Convert ``pages`` (page_id, url, html), taken as ARC records of both versions, to WARC archives in ``path``."""
    revisits, _ = stash(find_revisits(pages, min_bytes), "revisits")
    rows = pages.select("page_id", F.coalesce("url", F.lit("-")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).join(revisits, ["page_id", "sha"], "left")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for whole in batches:
            for page_id, url, html, refers_to in zip(*whole.columns, strict=True):
                page_id, refers_to = page_id.as_py(), refers_to.as_py()
                version = 1 + (page_id or 0) % 2
                arc = write_arc(ArcRecord(version, url.as_py(), "0.0.0.0", date, "text/html", html.as_py().encode()))
                yield from (to_warc(r, page_id, refers_to) for r in parse_arc(arc, version))

    _write(rows.select("page_id", "url", "html", "refers_to"), convert, path, file_bytes)


def _write(rows: DataFrame, convert: Callable[[Iterator[pa.RecordBatch]], Iterator[bytes]], path: str, file_bytes: int) -> None:
    """Write the records that ``convert`` makes of a task's rows to archives of that task."""

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held = TaskContext.get().partitionId(), 0, bytearray()
        names = ["path", "content"]
        for record in convert(batches):
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            held += packer.compress(record) + packer.compress(END.encode()) + packer.flush()
            if len(held) >= file_bytes:
                yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{n:05d}.warc.gz"]), pa.array([bytes(held)], pa.binary())], names=names)
                n, held = n + 1, bytearray()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{n:05d}.warc.gz"]), pa.array([bytes(held)], pa.binary())], names=names)

    write_files(rows.mapInArrow(archive, "path string, content binary"), path)


def convert_arcs(spark: SparkSession, source: str, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Convert the ARC archives below ``source`` (``*.arc``, ``*.arc.gz``) to WARC archives in ``path``; each states its version itself."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arc{,.gz}").option("recursiveFileLookup", "true").load(source).select("content")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                for record in parse_arc(b"".join(members(data)) if data[:2] == b"\x1f\x8b" else data):
                    yield to_warc(record, None)

    _write(files, convert, path, file_bytes)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, block) of the records in the archives."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda x: None if x is None else int(x)
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for member in members(content.as_py()):
                    for f, block in parse_warc(member):
                        sha, own = f["WARC-Payload-Digest"].removeprefix("sha1:"), digest(block)
                        if f["WARC-Block-Digest"] != f"sha1:{own}" or f["WARC-Type"] == "response" and own != sha:
                            raise ValueError(f"block of {f['WARC-Record-ID']} does not match its digest")
                        rows.append((whole(f.get("X-Page-ID")), f["WARC-Target-URI"], int(f["X-Payload-Length"]), sha, f["WARC-Type"], whole(f.get("X-Refers-To-Page-ID")), block))
                        size += len(block)
                    if len(rows) >= 500 or size >= 1 << 22:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "block"]
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, block binary"
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):  # nothing to write made no folder
            raise
        return spark.createDataFrame([], schema)
    return files.mapInArrow(parse, schema)


def convert_pages(pages: DataFrame, date: str = "20240101000000", min_bytes: int = 0) -> DataFrame:
    """Write the archives of ``pages`` to the shared folder and read them back."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, date, min_bytes)
    return read_archives(pages.sparkSession, path)
