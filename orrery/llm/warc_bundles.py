"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about frame_bytes; a bundle ends with the seek table of the public "seekable
format" (a skippable frame: per frame its compressed and decompressed size, then count, descriptor and magic number), so any frame can be
read alone. A Parquet index maps each record id to its bundle, frame, and offset and length within the frame.

Defined cases: null payload is empty; of rows with equal payloads of at least min_revisit_bytes bytes, every row that bears the largest id
is a response and the others revisit it (a null id revisits if some row of its group has an id); a null url omits the target URI, and line
breaks in one become %0A, %0D; rows repeated whole give records alike; an empty table gives no bundles and an empty index; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import committed_file, fits_broadcast, materialized, open_random, rows

# Fixed values of the public formats.
SEEKABLE_MAGIC = 0x8F92EAB1
SKIPPABLE_MAGIC = 0x184D2A5E
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "1970-01-01T00:00:00Z"

FRAMES_A_TASK = 256

INDEX_SCHEMA = "record_id string, bundle string, frame int, offset long, length long"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_uri(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def _page_id(uri: str) -> int | None:
    last = uri.strip("<>").rpartition(":")[2]
    return None if last == "null" else int(last)


def mark_revisits(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to): refers_to is null for responses.

    Groups that repeat are found on digests alone, with partial sums before the shuffle. They join back by broadcast when counted small,
    else by a sort-merge join whose hot digests Spark splits, from which payloads too small to be a revisit stay out."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    every = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    every = every.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    large = every.where(F.col("payload_bytes") >= min_revisit_bytes)
    groups = large.groupBy("payload_digest", "payload_bytes").agg(F.count("*").alias("n"), F.max("page_id").alias("response_id")).where("n > 1 AND response_id IS NOT NULL")
    groups = materialized(groups.select("payload_digest", "payload_bytes", "response_id"), "payload-groups")
    key = ["payload_digest", "payload_bytes"]
    if fits_broadcast(groups, 80):
        found = every.join(F.broadcast(groups), key, "left")
    else:
        small = every.where(F.col("payload_bytes") < min_revisit_bytes).withColumn("response_id", F.lit(None).cast("long"))
        found = large.join(groups, key, "left").unionByName(small)
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id"))
    return found.select("page_id", "url", "payload", "payload_bytes", "payload_digest", refers_to.alias("refers_to"))


def _record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_uri(page_id)}>", f"WARC-Date: {RECORD_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{record_uri(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Bundle:
    def __init__(self, out: pa.NativeFile, frame_bytes: int):
        self.out, self.frame_bytes, self.size = out, frame_bytes, 0
        self.compressor = zstandard.ZstdCompressor(level=3)
        self.held: list[bytes] = []
        self.held_bytes = 0
        self.frames: list[tuple[int, int]] = []

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset within it) of the record."""
        if self.held_bytes and self.held_bytes + len(record) > self.frame_bytes:
            self.flush()
        at = len(self.frames), self.held_bytes
        self.held.append(record)
        self.held_bytes += len(record)
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.compressor.compress(b"".join(self.held))
            self.out.write(packed)
            self.size += len(packed)
            self.frames.append((len(packed), self.held_bytes))
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC))


def write_bundles(marked: DataFrame, out_dir: str, frame_bytes: int = 2**18, bundle_bytes: int = 2**28) -> DataFrame:
    """Write the rows of mark_revisits() as bundles, a new one whenever a task's current one reaches bundle_bytes; return the index, read
    back from out_dir/index. A task holds one frame and a few payloads."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        small = iter(rows(batches, 64))
        batch = next(small, None)
        while batch is not None:
            uri = f"{out_dir}/bundle-{part:06d}-{number:04d}.warc.zst"
            number += 1
            with committed_file(uri) as out:
                bundle, index = _Bundle(out, frame_bytes), []
                while batch is not None and bundle.size < bundle_bytes:
                    for row in batch.to_pylist():
                        record = _record(row["page_id"], row["url"], row["payload"], row["payload_bytes"], row["payload_digest"], row["refers_to"])
                        index.append((record_uri(row["page_id"]), uri, *bundle.add(record), len(record)))
                    batch = next(small, None)
                bundle.close()
            columns = list(zip(*index, strict=True))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["record_id", "bundle", "frame", "offset", "length"])

    marked.mapInArrow(write, INDEX_SCHEMA).write.parquet(f"{out_dir}/index")
    return marked.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{out_dir}/index")


class BundleReader:
    """Reads single frames or records of a bundle by its seek table."""

    def __init__(self, uri: str):
        self.file = open_random(uri)
        size = self.file.size()
        self.file.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        self.file.seek(size - 9 - 8 * count)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", self.file.read(8 * count)):
            self.frames.append((at, packed, plain))
            at += packed
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        self.file.seek(at)
        return self.decompressor.decompress(self.file.read(packed), max_output_size=plain)

    def record(self, frame: int, offset: int, length: int) -> dict:
        return next(parse_records(self.frame(frame)[offset : offset + length]))


_CONTENT_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)")


def parse_records(frame: bytes) -> Iterator[dict]:
    """The records of a decompressed frame. A response's payload must match its digest."""
    at = 0
    while at < len(frame):
        head_end = frame.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in frame[at:head_end].decode().split("\r\n")[1:])
        block = frame[head_end + 4 : head_end + 4 + int(fields["Content-Length"])]
        http_end = block.index(b"\r\n\r\n") + 4
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        payload = block[http_end:] if fields["WARC-Type"] == "response" else None
        if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
        yield {
            "page_id": _page_id(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
            "refers_to": _page_id(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
            "payload_bytes": len(payload) if payload is not None else int(_CONTENT_LENGTH.search(block, 0, http_end)[1]), "payload_digest": digest, "payload": payload,
        }
        at = head_end + 4 + int(fields["Content-Length"]) + 4


def read_bundles(spark: SparkSession, out_dir: str, with_payload: bool = True) -> DataFrame:
    """Every record of every bundle; a task reads frames one by one through the seek table. Runs of neighbouring frames are dealt out by their
    count: to all cores, and more tasks where one would get more than FRAMES_A_TASK."""
    index = spark.read.schema(INDEX_SCHEMA).parquet(f"{out_dir}/index")
    frames = materialized(index.select("bundle", "frame").distinct(), "frames")
    count = frames.count()
    tasks = max(1, min(count, max(spark.sparkContext.defaultParallelism, -(-count // FRAMES_A_TASK))))
    frames = frames.repartitionByRange(tasks, "bundle", "frame")
    schema = RECORD_SCHEMA if with_payload else RECORD_SCHEMA.rpartition(",")[0]
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(n, types[x.split()[1]]) for n, x in zip(names, schema.split(", "), strict=True)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, BundleReader] = {}
        for batch in batches:
            for bundle, frame in sorted(zip(batch["bundle"].to_pylist(), batch["frame"].to_pylist(), strict=True)):
                if bundle not in opened:
                    opened = {bundle: BundleReader(bundle)}
                found = [{n: r[n] for n in names} for r in parse_records(opened[bundle].frame(frame))]
                yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return frames.mapInArrow(read, schema)


def fetch(spark: SparkSession, out_dir: str, record_id: str) -> list[dict]:
    """The records with this id, each by reading its one frame."""
    places = spark.read.schema(INDEX_SCHEMA).parquet(f"{out_dir}/index").where(F.col("record_id") == record_id).collect()
    return [BundleReader(x["bundle"]).record(x["frame"], x["offset"], x["length"]) for x in places]
