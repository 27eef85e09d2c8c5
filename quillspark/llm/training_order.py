"""Training-order materialisation of token ids.

A sequence is one document.  Sequences get a dense number (their place in the
scan of the table), a keyed Feistel permutation with cycle walking turns it
into a global slot, and each range of slots is written by one task as shards
of a fixed stride: shard ``s`` holds slots ``s * stride`` and up, so the place
of any slot follows by arithmetic and a reader resumes at any slot.  The ids
of a shard lie one after another, with a table of offsets behind them, and are
written as they come: no more than one document's ids stand in memory.

The order depends on the key and on the order of the table's files; written
shards never change.  Texts move once through a shuffle and are tokenized
behind it, so no task holds more than its range of slots.

Defined results: a null or empty text is a sequence without ids; repeated rows
are sequences of their own; a null id is kept; an empty table gives no shards.
A very long text is one sequence.  Other columns are not read, whatever their
names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, tokens
from .sharding import mix64

STRIDE = 1024
#: Shards that one task writes.
SHARDS_A_TASK = 4
ROUNDS = 6
MAGIC = b"QSHARD01"
FOOT = struct.Struct("<8sqqqq")  # magic, first slot, sequences, bytes of an id, ids


def feistel(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0..n-1: Feistel rounds on the next even number of bits, walked until inside."""
    if n <= 1:
        return np.zeros(len(index), np.int64)
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % 2**64))
    out = np.asarray(index, np.uint64).copy()
    live = np.arange(len(out))
    while len(live):
        left, right = out[live] >> half, out[live] & mask
        if inverse:
            for k in keys[::-1]:
                left, right = right ^ (mix64(left + k) & mask), left
        else:
            for k in keys:
                left, right = right, left ^ (mix64(right + k) & mask)
        out[live] = (left << half) | right
        live = live[out[live] >= np.uint64(n)]
    return out.astype(np.int64)


class ShardWriter:
    """One shard, put in place by one move: ids, then offsets, document ids and checksums, then the foot."""

    def __init__(self, uri: str, first: int, width: int):
        self.uri, self.first, self.width = uri, first, width
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.tmp, compression=None)
        self.doc_ids, self.offsets, self.crc32 = [], [0], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = ids.astype(f"<u{self.width}").tobytes()
        self.out.write(data)
        self.doc_ids.append(doc_id)
        self.offsets.append(self.offsets[-1] + len(ids))
        self.crc32.append(zlib.crc32(data))

    def close(self) -> int:
        known, ids = [x is not None for x in self.doc_ids], [x or 0 for x in self.doc_ids]
        for column in (self.offsets, known, ids, self.crc32):
            self.out.write(np.asarray(column, "<i8").tobytes())
        self.out.write(FOOT.pack(MAGIC, self.first, len(ids), self.width, self.offsets[-1]))
        self.out.close()
        self.fs.move(self.tmp, self.path)
        return len(ids)


class Shard:
    """Reads one shard, whole or from any slot on."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        magic, self.first, self.count, self.width, total = FOOT.unpack(self.file.read_at(FOOT.size, self.file.size() - FOOT.size))
        if magic != MAGIC:
            raise ValueError(f"not a shard: {uri}")
        tail = np.frombuffer(self.file.read_at(8 * (4 * self.count + 1), self.width * total), "<i8")
        self.offsets, rest = tail[: self.count + 1], tail[self.count + 1 :]
        known, ids, self.crc32 = rest.reshape(3, self.count)
        self.doc_ids = [int(i) if k else None for k, i in zip(known, ids)]

    def ids(self, slot: int) -> np.ndarray:
        n = slot - self.first
        at, to = int(self.offsets[n]), int(self.offsets[n + 1])
        return np.frombuffer(self.file.read_at(self.width * (to - at), self.width * at), f"<u{self.width}")


def materialise(docs: DataFrame, uri: str, key: int = 1, stride: int = STRIDE, ranks: str | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """Write ``docs``, a scan of files, as shards below ``uri``; returns a written table (file, shard, sequences)."""
    spark = docs.sparkSession
    ranks = ranks or tokens.vocabulary("byte_bpe_50k.tiktoken")
    held = spark.conf.get("spark.sql.files.minPartitionNum", None)
    # Both passes must cut the files alike, also if executors come or go between them.
    spark.conf.set("spark.sql.files.minPartitionNum", held or str(spark.sparkContext.defaultParallelism))
    try:
        place = F.monotonically_increasing_id()
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), place.alias("place"))
        # One count a scan partition.
        sizes = {r[0]: r[1] for r in rows.groupBy(F.shiftright("place", 33).alias("p")).count().collect()}
        # Two longs a scan partition go along with the numbering.
        known = np.asarray(sorted(sizes), np.int64)
        counts = np.asarray([sizes[p] for p in known.tolist()], np.int64)
        total, starts = int(counts.sum()), np.cumsum(counts) - counts

        @F.pandas_udf("long")
        def slot_of(place: pd.Series) -> pd.Series:
            at = place.to_numpy(np.int64)
            return pd.Series(feistel(starts[np.searchsorted(known, at >> 33)] + (at & ((1 << 33) - 1)), total, key))

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoding = tokens.byte_tokenizer(ranks)
            width = 2 if encoding.n_vocab <= 1 << 16 else 4
            out, shard, done = None, -1, []
            for batch in batches:
                for doc_id, text, slot in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if slot // stride != shard:
                        if out:
                            done.append((out.uri, shard, out.close()))
                        shard = slot // stride
                        out = ShardWriter(f"{uri}/shard-{shard:010d}.bin", shard * stride, width)
                    out.add(doc_id, np.asarray(encoding.encode_ordinary(text), np.uint32))
            if out:
                done.append((out.uri, shard, out.close()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done)) or [[], [], []], (pa.string(), pa.int64(), pa.int64()))], ["file", "shard", "sequences"])

        a_task = stride * SHARDS_A_TASK
        dealt = rows.select("doc_id", "text", slot_of("place").alias("slot")).repartitionById(max(1, -(-total // a_task)), F.expr(f"cast(slot div {a_task} as int)"))
        shards = scratch.stage(dealt.sortWithinPartitions("slot").mapInArrow(write, "file string, shard long, sequences long"), "shards")
        written = shards.agg(F.count(F.lit(1)), F.sum("sequences")).first()
        if (written[0], written[1] or 0) != (-(-total // stride), total):
            raise RuntimeError(f"{written[1]} of {total} sequences in {written[0]} shards: the table's scan changed between two passes")
        return shards
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if held is None else spark.conf.set("spark.sql.files.minPartitionNum", held)


def read_shards(shards: DataFrame, from_slot: int = 0) -> DataFrame:
    """What the shards hold from a slot on, read back: slot, shard, at (ids before it in its shard), doc_id, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = Shard(file)
                slots = range(max(s.first, from_slot), s.first + s.count)
                ids = [s.ids(slot) for slot in slots]
                crc = [zlib.crc32(x.tobytes()) for x in ids]
                skip = s.count - len(ids)
                if crc != s.crc32[skip:].tolist():
                    raise ValueError(f"damaged shard: {file}")
                yield pa.RecordBatch.from_pydict({
                    "slot": pa.array(list(slots), pa.int64()), "shard": pa.array([number] * len(ids), pa.int64()),
                    "at": pa.array(s.offsets[skip:-1]), "doc_id": pa.array(s.doc_ids[skip:], pa.int64()),
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                })

    files = shards.select("file", "shard").repartition(max(1, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return files.mapInArrow(read, "slot long, shard long, at long, doc_id long, n_tokens long, ids_crc32 long")


def training_order(docs: DataFrame, key: int = 1, stride: int = STRIDE) -> DataFrame:
    """Write all documents in training order, then read the shards back."""
    return read_shards(materialise(docs, scratch.fresh(docs.sparkSession, "training"), key, stride))
