"""Files from rows and rows from archives: one file an entity, zip and tar.xz archives, resumable downloads.

Executors write through a pyarrow file system opened from the folder's URI;
a name is fixed by its row, so a repeated task replaces its own file.

A tar.xz archive is a row of xz streams, each of whole files, which any tar
reads as one; they are packed and unpacked apart. The last one ends the tar,
and tells the sizes of the others behind that end, where tar reads no more.
"""

from __future__ import annotations

import io
import json
import lzma
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of files after which another part of an archive begins; longer ones take xz more time a byte, as they outgrow the caches.
PART = 1 << 20
#: Bytes of packed parts that a task holds before it writes them.
HELD = 1 << 23
END = bytes(2 * tarfile.BLOCKSIZE)
MARK = b"parts of this archive: "


def put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)


def write_files(rows: DataFrame, root: str) -> int:
    """Writes each row (path, data binary) as a file of its own below ``root`` (SNK05, SNK13); the number of them."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                put(fs, f"{base}/{path}", data or b"")
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["path"])

    return rows.select("path", F.col("data").cast("binary")).mapInArrow(write, "path string").count()


def packed(names: list[str], contents: list[bytes]) -> bytes:
    """A zip archive of the files, in the order of their names."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in sorted(zip(names, contents)):
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def tar_entry(name: str, data: bytes) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = len(data)
    return info.tobuf() + data + bytes(-len(data) % tarfile.BLOCKSIZE)


def tar_end(sizes: list[int]) -> bytes:
    """The last stream of an archive whose parts have these sizes."""
    end = END + MARK + json.dumps(sizes).encode()
    return lzma.compress(end + bytes(-len(end) % tarfile.RECORDSIZE))


def tar_parts(file: pa.NativeFile) -> list[tuple[int, int]]:
    """(start, size) of an archive's parts by its last stream; of an archive of other origin the whole."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (index[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if index[at - 1] < 128:
                return value, at

    size = file.size()
    whole = [(0, size)]
    foot = file.read_at(12, size - 12) if size > 32 else b""
    if foot[10:] != b"YZ":
        return whole
    length = (int.from_bytes(foot[4:8], "little") + 1) * 4
    if length + 24 > size:
        return whole
    index = file.read_at(length, size - 12 - length) + b"\0"
    blocks, at = number(1)
    start = size - 24 - length - (number(at)[0] + 3 & ~3)
    if blocks != 1 or start <= 0:
        return whole
    try:
        if not lzma.LZMADecompressor().decompress(file.read_at(min(size - start, 1 << 16), start), len(END + MARK)).startswith(END + MARK):
            return whole
        sizes = json.loads(lzma.decompress(file.read_at(size - start, start))[len(END + MARK) :].rstrip(b"\0"))
    except (lzma.LZMAError, ValueError):
        return whole
    starts = [0]
    for x in sizes:
        starts.append(starts[-1] + x)
    return list(zip(starts, sizes)) if starts[-1] == start else whole


def write_archives(rows: DataFrame, root: str, kind: str = "tar.xz") -> int:
    """Writes the rows (archive, name, data binary) as one archive for each name of ``archive`` (SNK19: a backup), files in the order of their names.

    A zip archive is built in memory; of a tar.xz, tasks pack parts of many
    archives or of one, which are then copied into one file.
    """
    if kind == "zip":

        def build(group: pa.Table) -> pa.Table:
            data = packed(group.column("name").to_pylist(), [x or b"" for x in group.column("data").to_pylist()])
            return pa.table({"path": [group.column("archive")[0].as_py()], "data": pa.array([data], pa.binary())})

        return write_files(rows.groupBy("archive").applyInArrow(build, "path string, data binary"), root)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        task, k, current, size, xz, held, sizes = TaskContext.get().partitionId(), 0, None, 0, None, [], []

        def end_part() -> None:
            held.append(xz.flush())
            sizes.append(sum(map(len, held)) - sum(sizes))

        def put_parts() -> pa.RecordBatch:
            path = f"{base}/.parts/{task}-{k}"
            put(fs, path, b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array([current]), pa.array([task]), pa.array([k]), pa.array([path]), pa.array([sizes], pa.list_(pa.int64()))], ["archive", "task", "k", "path", "sizes"])

        for batch in batches:
            for archive, name, data in zip(*(c.to_pylist() for c in batch.columns)):
                if xz and (archive != current or size >= PART):
                    end_part()
                    xz = None
                    if archive != current or sum(sizes) >= HELD:
                        yield put_parts()
                        k, held, sizes = k + 1, [], []
                if not xz:
                    current, size, xz = archive, 0, lzma.LZMACompressor()
                entry = tar_entry(name, data or b"")
                size += len(entry)
                held.append(xz.compress(entry))
        if xz:
            end_part()
            yield put_parts()

    def join(group: pa.Table) -> pa.Table:
        fs, base = pafs.FileSystem.from_uri(root)
        archive, parts = group.column("archive")[0].as_py(), group.sort_by([("task", "ascending"), ("k", "ascending")])
        path = f"{base}/{archive}"
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as out:
            for x in parts.column("path").to_pylist():
                with fs.open_input_stream(x) as file:
                    while data := file.read(1 << 20):
                        out.write(data)
            out.write(tar_end([x for sizes in parts.column("sizes").to_pylist() for x in sizes]))
        return pa.table({"path": [archive]})

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("archive", "name", F.col("data").cast("binary").alias("data")).repartitionByRange("archive", "name").sortWithinPartitions("archive", "name", "data")
    parts = ordered.mapInArrow(pack, "archive string, task long, k long, path string, sizes array<long>")
    written = parts.repartition(n, "archive").groupBy("archive").applyInArrow(join, "path string").count()
    if written:
        fs, base = pafs.FileSystem.from_uri(root)
        fs.delete_dir(f"{base}/.parts")
    return written


def archived(path: str, file) -> Iterator[tuple[str, bytes]]:
    """(name, data) of the files in an open archive."""
    try:
        if path.endswith(".tar.xz"):
            with lzma.open(file) as xz, tarfile.open(fileobj=xz, mode="r|") as t:
                yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile())
        else:
            with zipfile.ZipFile(file) as z:
                yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
    except (tarfile.TarError, zipfile.BadZipFile, lzma.LZMAError, EOFError, OSError):
        return


def in_batches(rows: Iterator[tuple[str, str, bytes]], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows (archive, name, data) in batches of some megabytes."""
    held, size = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.string(), pa.binary()))], ["archive", "name", "data"])
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= most or len(held) >= 10000:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def unpack(spark: SparkSession, root: str, pattern: str = "*.{cbz,zip,tar.xz}") -> DataFrame:
    """(archive, name, data) of all files in the archives of a folder tree (SRC27); folders inside are passed over, broken archives give no rows.

    Archives are read a file at a time, those of ``write_archives`` by their
    parts; where Spark alone can open the folder, each in one cell.
    """
    schema = "archive string, name string, data binary"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    try:
        base = pafs.FileSystem.from_uri(root)[1].rstrip("/")
    except (pa.ArrowException, OSError):

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return in_batches((path, *x) for batch in batches for path, data in zip(batch.column(0).to_pylist(), batch.column(1)) for x in archived(path, io.BytesIO(data.as_py())))

        return found.select("path", "content").mapInArrow(whole, schema)
    name = lambda path: base + path[path.index(base) + len(base) :]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(name(path)) as file:
                    parts = tar_parts(file) if path.endswith(".tar.xz") else [(0, file.size())]
                yield pa.RecordBatch.from_pydict({"archive": [path] * len(parts), "start": [x for x, _ in parts], "size": [x for _, x in parts]})

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, bytes]]:
        fs, _ = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(name(path)) as file:
                    part = file if size == file.size() else io.BytesIO(file.read_at(size, start))
                    yield from ((path, *x) for x in archived(path, part))

    n = max(spark.sparkContext.defaultParallelism, (found.agg(F.sum("length")).first()[0] or 0) >> 22)
    parts = found.select("path").mapInArrow(locate, "archive string, start long, size long")
    return parts.repartition(n).mapInArrow(lambda batches: in_batches(files(batches)), schema)


def download(rows: DataFrame, root: str, fetch: Callable[[str], bytes | None]) -> DataFrame:
    """Fetches (url, path) into files below ``root`` (SRC24): (path, state), ``there`` where the file stood already, ``failed`` where ``fetch`` gave nothing, so that the next run tries again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            states = []
            for url, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if fs.get_file_info(f"{base}/{path}").type == pafs.FileType.File:
                    states.append("there")
                    continue
                data = fetch(url)
                if data is not None:
                    put(fs, f"{base}/{path}", data)
                states.append("failed" if data is None else "fetched")
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(states, pa.string())], ["path", "state"])

    return rows.select("url", "path").mapInArrow(run, "path string, state string")
