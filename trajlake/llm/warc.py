"""WARC archives as seekable Zstandard bundles.

A bundle is one whole archive: records are put together to frames of about `frame_bytes`, each frame is compressed on its
own, and a skippable frame at the end holds the seek table (compressed and plain size of every frame), as in the seekable
format. An index maps each record to its bundle, frame and offset in the plain frame, so that one record is read by
decompressing one frame. Bundles are rows of a Parquet table with the archive in a binary column: Spark's committer then
makes the output safe against lost and repeated tasks on any file system; export_bundles() writes them as files.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import map_batches
from ._skew import join_groups

#: Fixed values of the seekable format and of the archive format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
VERSION = b"WARC/1.1"
IDENTICAL = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BUNDLES = "bundle string, n_records long, n_frames int, data binary, entries array<struct<page_id: long, frame: int, offset: long, length: long>>"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, bundle string, frame int, offset long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"none" if page_id is None else b"%d" % page_id)


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def _line(text: str) -> bytes:
    """A header value: controls and spaces percent-encoded, and the per cent sign before them."""
    return b"".join(b"%%%02X" % c if c <= 0x20 or c in (0x25, 0x7F) else bytes([c]) for c in text.encode())


def _unline(value: bytes) -> str:
    first, *rest = value.split(b"%")
    return b"".join([first, *(bytes([int(x[:2], 16)]) + x[2:] for x in rest)]).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record; its block is an HTTP response, for a revisit the headers alone, whose Content-Length stays the payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + _name(page_id), b"WARC-Date: " + date.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _line(url))
    head.append(b"WARC-Payload-Digest: sha1:" + digest(payload).encode())
    if revisit:
        head += [b"WARC-Profile: " + IDENTICAL, b"WARC-Refers-To: " + _name(refers_to)]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(frame: bytes) -> Iterator[tuple[int, dict[str, bytes], bytes]]:
    """(offset, headers by lower-case name, block) of each record of a plain frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        version, *lines = frame[at:end].split(b"\r\n")
        if version != VERSION:
            raise ValueError("not a record")
        headers = {k.decode().lower(): v.strip() for k, v in (x.split(b":", 1) for x in lines)}
        size = int(headers["content-length"])
        yield at, headers, frame[end + 4 : end + 4 + size]
        at = end + 8 + size


class BundleWriter:
    """Collects records; close() gives the archive with its seek table."""

    def __init__(self, frame_bytes: int = 1 << 18, level: int = 3):
        self.frame_bytes, self.compressor = frame_bytes, zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        self.pending, self.pending_bytes = [], 0
        self.frames, self.sizes, self.entries, self.bytes = [], [], [], 0

    def add(self, page_id: int | None, record: bytes) -> None:
        self.entries.append({"page_id": page_id, "frame": len(self.frames), "offset": self.pending_bytes, "length": len(record)})
        self.pending.append(record)
        self.pending_bytes += len(record)
        if self.pending_bytes >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.pending:
            self.frames.append(self.compressor.compress(b"".join(self.pending)))
            self.sizes.append((len(self.frames[-1]), self.pending_bytes))
            self.bytes += len(self.frames[-1])
            self.pending, self.pending_bytes = [], 0

    def close(self) -> bytes:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def frame_table(archive: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the seek table in the footer."""
    count, flags, magic = struct.unpack_from("<IBI", archive, len(archive) - 9)
    each = 12 if flags & 0x80 else 8
    if magic != SEEKABLE or struct.unpack_from("<I", archive, len(archive) - 17 - count * each)[0] != SKIPPABLE:
        raise ValueError("no seek table")
    out, start = [], 0
    for k in range(count):
        packed, plain = struct.unpack_from("<II", archive, len(archive) - 9 - (count - k) * each)
        out.append((start, packed, plain))
        start += packed
    return out


def read_frame(archive: bytes, frame: int) -> bytes:
    start, packed, plain = frame_table(archive)[frame]
    out = zstandard.ZstdDecompressor().decompress(archive[start : start + packed])
    if len(out) != plain:
        raise ValueError("a frame's size differs from the seek table")
    return out


def record_kinds(pages: DataFrame, page_id: str, payload: str, least: int) -> DataFrame:
    """page_id, url and payload with `revisit` and `refers_to`: of equal payloads of at least `least` bytes that with the
    largest id is the response, the others revisit it. Rows without an id are responses, and are never referred to."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col("url"), body.alias("payload"))
    rows = rows.withColumn("sha", F.when((F.octet_length("payload") >= least) & F.col("page_id").isNotNull(), F.unhex(F.sha1(F.col("payload").cast("binary")))))
    groups = rows.filter(F.col("sha").isNotNull()).groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("size")).filter("size > 1")
    duplicates = join_groups(rows.select("page_id", "sha"), groups, ["sha"], "size", pages.count())
    revisits = duplicates.filter("page_id < refers_to").select("page_id", "sha", "refers_to").distinct()
    named = rows.filter(F.col("sha").isNotNull()).join(revisits, ["page_id", "sha"], "left")
    plain = rows.filter(F.col("sha").isNull()).withColumn("refers_to", F.lit(None).cast(dict(rows.dtypes)["page_id"]))  # no join, so that null ids don't meet in a task
    return named.unionByName(plain).withColumn("revisit", F.col("refers_to").isNotNull())


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", payload: str = "html", least: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 22, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record per row of pages to bundles at `path`, a new Parquet folder.

    A null payload is empty. Equal rows (same id, same payload) are all responses or all revisits. A bundle is closed at
    `bundle_bytes`; a payload of any size is one record in its own frame. An empty table gives an empty folder.
    """
    kinds = record_kinds(pages, page_id, payload, least)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, writer = TaskContext.get().partitionId(), 0, BundleWriter(frame_bytes)

        def closed() -> pa.RecordBatch:
            data = writer.close()
            row = {"bundle": f"{part:06d}-{made:05d}", "n_records": len(writer.entries), "n_frames": len(writer.frames), "data": data, "entries": writer.entries}
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    record = make_record(row["page_id"], row["url"], row["payload"].encode(), row["refers_to"], row["revisit"], date)
                    writer.add(row["page_id"], record)
                    if writer.bytes >= bundle_bytes:
                        yield closed()
                        made, writer = made + 1, BundleWriter(frame_bytes)
        if writer.entries:
            yield closed()

    map_batches(kinds.select("page_id", "url", "payload", "refers_to", "revisit"), bundle, BUNDLES).write.option("compression", "uncompressed").parquet(path)


ARROW = pa.schema([("bundle", pa.string()), ("n_records", pa.int64()), ("n_frames", pa.int32()), ("data", pa.binary()), ("entries", pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])))])
RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64())])


def parsed(bundle: str, frame: int, offset: int, headers: dict[str, bytes], block: bytes) -> dict:
    """A record as a row; a response's payload is tested against its digest."""
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind, told = headers["warc-type"].decode(), headers["warc-payload-digest"].decode().removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest(payload) != told):
        raise ValueError("a payload differs from its digest")
    return {
        "page_id": _page(headers["warc-record-id"].decode()), "url": _unline(headers["warc-target-uri"]) if "warc-target-uri" in headers else None,
        "record_type": kind, "refers_to": _page(headers["warc-refers-to"].decode()) if kind == "revisit" else None,
        "payload_digest": told, "payload_bytes": length, "payload": payload if kind == "response" else None, "bundle": bundle, "frame": frame, "offset": offset,
    }


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the bundles at `path`. A revisit has its payload's size from the HTTP headers and no payload."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, archive in zip(batch.column("bundle").to_pylist(), batch.column("data"), strict=True):
                archive = archive.as_py()
                for k in range(len(frame_table(archive))):
                    rows = [parsed(name, k, *x) for x in parse_records(read_frame(archive, k))]
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORD_ARROW)

    return map_batches(spark.read.schema(BUNDLES).parquet(path).select("bundle", "data"), records, RECORDS)


def index(spark: SparkSession, path: str) -> DataFrame:
    """page_id, bundle, frame, offset and length (in the plain frame) of every record."""
    return spark.read.schema(BUNDLES).parquet(path).select("bundle", F.explode("entries").alias("e")).select("e.page_id", "bundle", "e.frame", "e.offset", "e.length")


def fetch(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The records of the page_ids in `ids`: only their frames are decompressed."""
    wanted = index(spark, path).join(ids.select("page_id").distinct(), "page_id")
    by_bundle = wanted.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("places"))
    found = spark.read.schema(BUNDLES).parquet(path).select("bundle", "data").join(by_bundle, "bundle")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                frames: dict[int, set[int]] = {}
                for place in row["places"]:
                    frames.setdefault(place["frame"], set()).add(place["offset"])
                for k, offsets in sorted(frames.items()):
                    rows = [parsed(row["bundle"], k, *x) for x in parse_records(read_frame(row["data"], k)) if x[0] in offsets]
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORD_ARROW)

    return map_batches(found, records, RECORDS)


def export_bundles(spark: SparkSession, path: str, folder: str) -> None:
    """Write every bundle as folder/<bundle>.warc.zst; `folder` must be one that all executors mount. Safe to repeat."""

    def save(rows) -> None:
        for row in rows:
            target = f"{folder}/{row.bundle}.warc.zst"
            with open(f"{target}.{os.getpid()}", "wb") as file:
                file.write(row.data)
            os.replace(file.name, target)

    spark.read.schema(BUNDLES).parquet(path).select("bundle", "data").foreachPartition(save)
