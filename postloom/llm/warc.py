"""WARC bundles of independent Zstandard frames with a seek table.

Records are grouped into frames, each compressed on its own; a bundle ends with a skippable frame that
holds every frame's compressed and uncompressed size (the public seekable format), so one record is
read by fetching the footer, one frame, and the record at its offset in the frame.  The index maps a
record to (bundle, frame, offset in the frame, length).

Tasks write bundles straight to the shared folder under names that hold the task attempt, so a repeated
or speculative attempt never touches another's file; the index, written through Spark's committer, names
only what successful attempts wrote.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, new_path, small_batches
from ..skew import with_group

FRAME_BYTES = 1 << 18
FRAME_RECORDS = 64
BUNDLE_BYTES = 1 << 28
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
#: Digests with several records that are broadcast at most (60 bytes each); beyond it records meet them by a shuffle that splits hot digests.
BROADCAST_DIGESTS = 500_000
#: Uncompressed bytes of records that a task reads back, at most and, where tasks would be idle, at least.
READ_BYTES, LEAST_READ_BYTES = 1 << 27, 1 << 22

#: Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "page_id {kind}, bundle string, frame int, at int, length int"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in value)


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A response record, or a revisit of an identical payload, which holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in data.decode().split("\r\n")[1:])


def parse(data: bytes) -> dict:
    """A record's fields; the payload of a response is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, kind = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"]
    size = int(_headers(http)["Content-Length"])
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {warc['WARC-Record-ID']}")
    page = lambda name: warc[name].removeprefix("<urn:page:").removesuffix(">") or None if name in warc else None
    return {"page_id": page("WARC-Record-ID"), "url": warc.get("WARC-Target-URI"), "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page("WARC-Refers-To")}


class BundleWriter:
    """Writes records into frames of one bundle."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        self.path, self.out, self.size, self.frames = path, fs.open_output_stream(path, compression=None), 0, []
        self.buffer, self.held = bytearray(), 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Append a record: its frame, offset in the frame, and length."""
        if self.held and (self.held == FRAME_RECORDS or len(self.buffer) + len(data) > FRAME_BYTES):
            self.flush()
        at = len(self.frames), len(self.buffer), len(data)
        self.buffer += data
        self.held += 1
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.packer.compress(bytes(self.buffer))
            self.out.write(packed)
            self.frames.append((len(packed), len(self.buffer)))
            self.size += len(packed)
            self.buffer, self.held = bytearray(), 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=max(plain, 1))


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:/"):
        return pyarrow.fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return pyarrow.fs.LocalFileSystem(), uri


def write_bundles(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row and return the index (page_id, bundle, frame, at, length).

    Of the rows with equal payloads that with the largest id is a response, the others revisit it; a
    null html is an empty payload.  A row with a null id is always a response, and none refers to it.
    Rows that repeat both the largest id and the payload are all responses.  Other columns are ignored.
    ``folder`` must be one that all executors share; the default is below ``spark.checkpoint.dir``.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or new_path(spark, "warc")
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    kind = pages.schema[id_col].dataType.simpleString()
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    last = rows.groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("page_id").alias("n")).where("n > 1").select("sha1", "last")
    last = materialize(last, "repeated")
    refers_to = F.when(F.col("page_id") != F.col("last"), F.col("last")).alias("refers_to")
    if last.count() <= BROADCAST_DIGESTS:
        typed = rows.join(F.broadcast(last), "sha1", "left")
    else:
        typed = with_group(rows, "sha1", "page_id", rows.count(), F.max("page_id").alias("last"))
    typed = typed.select("page_id", "url", "html", refers_to)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = _filesystem(folder)
        writer, number = None, 0
        for batch in batches:
            index = []
            for page_id, url, text, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    writer, number = BundleWriter(fs, f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst"), number + 1
                index.append((writer.path.rsplit("/", 1)[1], *writer.add(record(page_id, url, text.encode(), refers_to))))
                if writer.size > BUNDLE_BYTES:
                    writer.close()
                    writer = None
            columns = list(zip(*index, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.string()), *(pa.array(x, pa.int32()) for x in columns[1:])], ["page_id", "bundle", "frame", "at", "length"])
        if writer is not None:
            writer.close()

    index = materialize(typed.mapInArrow(write, INDEX.format(kind=kind)), "index")
    return index.withColumn("bundle", F.concat(F.lit(folder + "/"), "bundle"))


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records that the index names, read back frame by frame.

    (page_id, payload_bytes, payload_digest, record_type, refers_to), and with ``payloads`` also url and
    payload (null for revisits).  Only the frames that hold wanted records are fetched.
    """
    kind = index.schema["page_id"].dataType.simpleString()
    size = index.agg(F.sum(F.col("length").cast("long"))).first()[0] or 0
    tasks = max(1, -(-size // READ_BYTES), min(index.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_READ_BYTES)))
    # by range, so that a task opens few bundles; the number of tasks goes by the records' bytes, not by the index's
    frames = index.repartitionByRange(tasks, "bundle", "frame").groupBy("bundle", "frame").agg(F.collect_list(F.struct("at", "length")).alias("records"))  # at most FRAME_RECORDS
    frames = frames.sortWithinPartitions("bundle", "frame")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * payloads
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.string(), pa.binary()] * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, reader = None, None
        for batch in batches:
            for bundle, frame, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != path:
                    path, reader = bundle, BundleReader(*_filesystem(bundle))
                data = reader.frame(frame)
                found = [parse(data[r["at"] : r["at"] + r["length"]]) for r in records]
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], t) for n, t in zip(names, types, strict=True)], names)

    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", url string, payload binary" * payloads
    out = frames.mapInArrow(read, schema)
    return out.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write all rows, then read every record back from the bundles."""
    return read_records(write_bundles(pages, **columns))
