"""Binary codecs: slot payloads, region files, packs and profiler reports.

These formats are bytes inside bytes, so they are read in Python, whole files or
payloads at a time, and give rows to which everything else is DataFrame code.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SECTOR, SLOTS = 4096, 1024
#: Payload kinds, and the bit that says the bytes are in a file of their own.
GZIP, ZLIB, PLAIN, EXTERNAL = 1, 2, 3, 128


def inflate(kind: int, data: bytes) -> bytes:
    """The bytes of a payload; an error if they are cut short or damaged."""
    if kind == PLAIN:
        return data
    if kind not in (GZIP, ZLIB):
        raise ValueError(f"unknown payload kind {kind}")
    reader = zlib.decompressobj(31 if kind == GZIP else 15)
    out = reader.decompress(data) + reader.flush()
    if not reader.eof:
        raise ValueError("payload is cut short")
    return out


def payload_status(payload: bytes | None) -> str:
    """ok, empty, external, or what is wrong with a payload (a kind byte and data)."""
    if not payload:
        return "empty"
    if payload[0] & EXTERNAL and len(payload) == 1:
        return "external"
    try:
        inflate(payload[0] & ~EXTERNAL, payload[1:])
    except (ValueError, zlib.error) as e:
        return f"corrupt: {e}" if isinstance(e, ValueError) else "corrupt: bad data"
    return "ok"


@F.pandas_udf(StringType())
def payload_integrity(payload: pd.Series) -> pd.Series:
    """``payload_status`` of a binary column."""
    return payload.map(lambda b: payload_status(None if b is None else bytes(b)))


def read_region(data: bytes, validate: bool = True) -> Iterator[tuple[int, bytes | None, str]]:
    """(slot, payload, status) of every used slot of a region file.

    A payload is the kind byte and the data.  Status is ok or external, or else says what is
    wrong: a location past the end, a length that does not fit, or (with ``validate``) data that do not inflate.
    """
    if len(data) < 2 * SECTOR:
        if data:
            yield -1, None, "torn: header"
        return
    for slot, location in enumerate(struct.unpack(f">{SLOTS}I", data[:SECTOR])):
        first, count = location >> 8, location & 255
        if not location:
            continue
        begin = first * SECTOR
        if first < 2 or begin + 5 > len(data):
            yield slot, None, "torn: location"
            continue
        (length,) = struct.unpack_from(">I", data, begin)
        if length < 1 or length + 4 > count * SECTOR or begin + 4 + length > len(data):
            yield slot, None, "torn: length"
            continue
        payload = data[begin + 4 : begin + 4 + length]
        if payload[0] & EXTERNAL:
            yield slot, payload, "external" if length == 1 else "torn: stub"
        else:
            yield slot, payload, payload_status(payload) if validate else "ok"


def write_region(slots: dict[int, bytes]) -> tuple[bytes, dict[int, bytes]]:
    """A region file of payloads by slot, and the data of those that need files of their own.

    Slots go in order from the third sector on; times are zero; more than 255 sectors are external, and so is what was.
    """
    table, body, outside, at = [0] * SLOTS, [], {}, 2
    for slot, payload in sorted(slots.items()):
        if payload[0] & EXTERNAL and len(payload) < 2:
            raise ValueError(f"external payload of slot {slot} has no bytes")
        if payload[0] & EXTERNAL or -(-(4 + len(payload)) // SECTOR) > 255:
            outside[slot], payload = payload[1:], bytes([payload[0] | EXTERNAL])
        count = -(-(4 + len(payload)) // SECTOR)
        table[slot] = at << 8 | count
        body.append((struct.pack(">I", len(payload)) + payload).ljust(count * SECTOR, b"\0"))
        at += count
    return struct.pack(f">{SLOTS}I", *table) + bytes(SECTOR) + b"".join(body), outside


def write_pack(records: list[tuple[bytes, bytes]]) -> bytes:
    """Records of a hash, a length and bytes, one after another."""
    return b"".join(h + struct.pack(">I", len(b)) + b for h, b in records)


def read_pack(data: bytes, hash_bytes: int = 16) -> Iterator[tuple[bytes, int, bytes]]:
    """(hash, offset of the bytes, bytes) of a pack's records; a torn last record is left out."""
    at, frame = 0, hash_bytes + 4
    while at + frame <= len(data):
        (length,) = struct.unpack_from(">I", data, at + hash_bytes)
        if at + frame + length > len(data):
            return
        yield data[at : at + hash_bytes], at + frame, data[at + frame : at + frame + length]
        at += frame + length


def scan_packs(spark: SparkSession, folder: str, hash_bytes: int = 16) -> DataFrame:
    """(pack_id, offset, hash, length, payload) of every record of the packs (``<number>.pack``) below a folder, pack by pack where it is read.

    Written with ``write_objects`` it is a table that finds single hashes without a scan.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pack").option("recursiveFileLookup", "true").load(folder)
    number = F.regexp_extract("path", r"(\d+)\.pack$", 1).try_cast("long")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pack_id, content in zip(batch["pack_id"], batch["content"], strict=True):
                found = list(read_pack(bytes(content), hash_bytes))
                for at in range(0, len(found), 1000):
                    some = found[at : at + 1000]
                    yield pd.DataFrame({"pack_id": pack_id, "offset": [o for _, o, _ in some], "hash": [h.hex() for h, _, _ in some], "length": [len(b) for _, _, b in some], "payload": [b for _, _, b in some]})

    return files.select(number.alias("pack_id"), "content").mapInPandas(parse, "pack_id long, offset long, hash string, length long, payload binary")


def write_objects(objects: DataFrame, path: str) -> None:
    """Objects as a table in the order of their hashes, with bloom filters: look-ups read the row groups that may hold a hash, and of these the pages."""
    ordered = objects.repartitionByRange("hash").sortWithinPartitions("hash")
    ordered.write.mode("overwrite").option("parquet.bloom.filter.enabled#hash", "true").option("parquet.bloom.filter.expected.ndv#hash", "1000000").parquet(path)


def look_up(objects: DataFrame, hashes: list[str]) -> DataFrame:
    """The objects of some hashes; an error names one that is not there."""
    wanted = objects.sparkSession.createDataFrame([(h,) for h in dict.fromkeys(hashes)], "hash string")
    found = wanted.join(objects.where(F.col("hash").isin(hashes)), "hash", "left")
    missing = F.raise_error(F.concat(F.lit("no such object: "), F.col("hash"))).cast("long")
    return found.withColumn("length", F.coalesce("length", missing))


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message: integers, or raw bytes of the other kinds."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire kind {kind}")
        yield key >> 3, value


def doubles(data: bytes) -> list[float]:
    """A packed field of doubles."""
    return list(struct.unpack(f"<{len(data) // 8}d", data))
