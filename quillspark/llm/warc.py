"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames.  Behind the data frames comes a
skippable frame with a record index (record id -> frame, offset and length in
the frame), then the seek table, so one record is read by decompressing one
frame.  Bundles are written under a name fixed by the task's partition and put
in place by one move, so a repeated task replaces its own file whole.

Which bundle and frame hold a record is read from the indexes alone, so records
are fetched by id from any number of bundles, a frame each.

Defined results: a null html is an empty payload; a null url is written as
``about:blank``; a record without id keeps a null id, and within a group of
equal payloads it revisits the largest id, if there is one.  Rows that repeat
the largest id of their payload are each a response.  A very long html is one
record in a frame of its own.  An empty table gives no bundles and an empty
result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .keyfilter import marked

# Fixed values of the Zstandard seekable format.
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
#: Any other skippable frame number may carry the record index.
SKIPPABLE_INDEX = 0x184D2A5D

INDEX_ENTRY = struct.Struct("<?qIII")
WARC_DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_uri(page_id: int | None) -> str:
    """``WARC-Record-ID`` of a page: reversible for 64-bit ids, random for a page without id."""
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid4()}>"
    return f"<urn:uuid:{uuid.UUID(int=(0x5175696C6C0080 << 72) | (page_id & (2**64 - 1)))}>"


def page_of(uri: str) -> int:
    """The page id of a :func:`record_uri`."""
    low = uuid.UUID(uri.strip("<>").removeprefix("urn:uuid:")).int & (2**64 - 1)
    return low - (1 << 64) if low >> 63 else low


def make_record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """One record; ``payload`` is None for a revisit, which keeps the full payload's size and digest."""
    http = HTTP_HEAD.format(size).encode()
    block = http + (payload or b"")
    kind = "response" if payload is not None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is None:
        head.append("X-No-Id: 1")
    if payload is None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one record; the digest of a response is computed from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    if kind == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    else:
        size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    return {
        "page_id": None if "X-No-Id" in fields else page_of(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None,
        "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None,
    }


class BundleWriter:
    """Writes records as frames of about ``frame_bytes``, then the index and the seek table."""

    def __init__(self, uri: str, frame_bytes: int, level: int = 3):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.tmp, compression=None)
        self.frame_bytes, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.buffer, self.held, self.frames, self.index, self.written = [], 0, [], [], 0

    def add(self, page_id: int | None, record: bytes) -> None:
        self.index.append((page_id is None, page_id or 0, len(self.frames), self.held, len(record)))
        self.buffer.append(record)
        self.held += len(record)
        if self.held >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.buffer:
            packed = self.zstd.compress(b"".join(self.buffer))
            self.out.write(packed)
            self.frames.append((len(packed), self.held))
            self.written += len(packed)
            self.buffer, self.held = [], 0

    def close(self) -> int:
        self.flush()
        index = b"".join(INDEX_ENTRY.pack(*x) for x in self.index)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<II", *x) for x in [*self.frames, (len(index) + 8, 0)])
        table += struct.pack("<IBI", len(self.frames) + 1, 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.tmp, self.path)
        return len(self.index)


class BundleReader:
    """Random access to the records of one bundle."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"no seek table in {uri}")
        table = self.file.read_at(8 * count, end - 9 - 8 * count)
        self.frames, at = [], 0
        for packed, size in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, size))
            at += packed
        start, packed, _ = self.frames.pop()
        self.index = list(INDEX_ENTRY.iter_unpack(self.file.read_at(packed, start)[8:]))
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, n: int) -> bytes:
        at, packed, size = self.frames[n]
        return self.zstd.decompress(self.file.read_at(packed, at), max_output_size=size)

    def find(self, page_id: int) -> dict | None:
        """The record of a page, by decompressing one frame."""
        for null, own, frame, at, size in self.index:
            if own == page_id and not null:
                return parse_record(self.frame(frame)[at : at + size])
        return None

    def records(self) -> Iterator[dict]:
        held, data = -1, b""
        for _, _, frame, at, size in self.index:
            if frame != held:
                held, data = frame, self.frame(frame)
            yield parse_record(data[at : at + size])


def mark_revisits(pages: DataFrame, least: int = 0, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Each page with its payload's digest and, if it repeats a payload of at least ``least`` bytes, the page it refers to.

    Digests that stand once are told by a bounded filter, and their pages are
    not shuffled.  Of the others, those that keep the payload are met by digest
    and id, and those that refer to it go without their html, so copies of one
    payload, however many, never meet with it in one place.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"),
        F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("size"),
    )
    repeated = rows.groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    repeated = scratch.stage(repeated.where((F.col("n") > 1) & (F.col("size") >= least) & F.col("keeper").isNotNull()).select("digest", "size", "keeper"), "repeated")
    told = marked(rows, repeated, ["digest", "size"])
    columns = ["page_id", "url", "size", "digest", "html"]
    # Kept: pages that no copy has, and of repeated payloads the keepers.
    alone = told.where(~F.col("maybe")).select(*columns)
    some = told.where("maybe").select(*columns)
    first = some.join(repeated.withColumnRenamed("keeper", "page_id"), ["digest", "size", "page_id"], "left_semi").select(*columns)
    narrow = some.drop("html").join(repeated, ["digest", "size"], "left")
    missed = narrow.where("keeper is null").groupBy("digest", "size").agg(F.lit(1).alias("x")).drop("x")
    others = some.join(scratch.stage(missed, "missed"), ["digest", "size"], "left_semi").select(*columns)
    kept = alone.unionByName(first).unionByName(others).withColumn("refers_to", F.lit(None).cast("long"))
    again = narrow.where("keeper is not null and not (keeper <=> page_id)").select("page_id", "url", "size", "digest", F.lit(None).cast("string").alias("html"), F.col("keeper").alias("refers_to"))
    return kept.unionByName(again)


def write_archives(pages: DataFrame, uri: str, least: int = 0, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 28, **columns) -> DataFrame:
    """Write the pages' records below ``uri``; returns a written table (file, records) of the bundles."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, n = None, TaskContext.get().partitionId(), 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            names = batch.schema.names
            for page_id, url, size, digest, html, refers_to in zip(*(batch.column(names.index(c)).to_pylist() for c in ("page_id", "url", "size", "digest", "html", "refers_to"))):
                if out is None:
                    name = f"{uri}/part-{part:06d}-{n:04d}.warc.zst"
                    out, n = BundleWriter(name, frame_bytes), n + 1
                payload = None if html is None else html.encode("utf-8", "surrogatepass")
                out.add(page_id, make_record(page_id, url, payload, size, base64.b32encode(bytes.fromhex(digest)).decode(), refers_to))
                if out.written >= bundle_bytes:
                    done.append((name, out.close()))
                    out = None
        if out is not None:
            done.append((name, out.close()))
        yield pa.RecordBatch.from_pydict({"file": pa.array([x[0] for x in done], pa.string()), "records": pa.array([x[1] for x in done], pa.int64())})

    marked = mark_revisits(pages, least, **columns)
    return scratch.stage(marked.mapInArrow(write, "file string, records long"), "warc-index")


def read_archives(bundles: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of all bundles named in ``bundles.file``, verified against their digests."""
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    if payloads:
        kinds += [("url", pa.string()), ("payload", pa.binary())]
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, held = [], 0
                for record in BundleReader(file).records():
                    rows.append(record)
                    held += 200 + (len(record["payload"] or b"") if payloads else 0)
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in kinds})
                        rows, held = [], 0
                yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in kinds})

    files = bundles.select("file").repartition(max(1, int(bundles.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return files.mapInArrow(read, ", ".join(f"{k} {names[t]}" for k, t in kinds))


def record_map(bundles: DataFrame) -> DataFrame:
    """(page_id, file, frame, at, size) of all records, from the bundles' indexes; no frame is read.  Records without id have a null one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                index = BundleReader(file).index
                for i in range(0, len(index), 1 << 16):
                    null, own, *place = zip(*index[i : i + (1 << 16)])
                    ids = [None if n else x for n, x in zip(null, own)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([file] * len(ids)), *(pa.array(c, pa.int64()) for c in place)], ["page_id", "file", "frame", "at", "size"])

    return bundles.select("file").mapInArrow(read, "page_id long, file string, frame long, at long, size long")


def fetch(places: DataFrame, ids: DataFrame) -> DataFrame:
    """(page_id, record) of the records of some ids, by their rows in a :func:`record_map`; each needed frame is read once."""

    def read(group: pa.Table) -> pa.Table:
        data = BundleReader(group.column("file")[0].as_py()).frame(group.column("frame")[0].as_py())
        records = [data[at : at + size] for at, size in zip(group.column("at").to_pylist(), group.column("size").to_pylist())]
        return pa.table({"page_id": group.column("page_id"), "record": pa.array(records, pa.binary())})

    return places.join(ids.select("page_id").distinct(), "page_id").groupBy("file", "frame").applyInArrow(read, "page_id long, record binary")


def archive_pages(pages: DataFrame, uri: str | None = None, least: int = 0) -> DataFrame:
    """Write all pages as archives, then read the archives back."""
    spark: SparkSession = pages.sparkSession
    return read_archives(write_archives(pages, uri or scratch.fresh(spark, "warc"), least))
