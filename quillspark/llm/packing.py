"""Hierarchical residual packing of documents into sequences.

Pieces are dealt evenly over partitions.  Each partition packs its pieces best
fit, longest first.  Nearly full bins are emitted; the others go on as items
that can be joined whole, and a tree of ever fewer partitions packs them best
fit again until a round joins nothing more or one partition is left.

Within one partition no two bins of a best-fit round fit together, so at most
one of them is at most half full: what goes up the tree to be joined are those
bins and the bins with room for them, and its size falls with each round.

Defined results: a null or empty text is one piece holding the end id alone.
Repeated rows are packed each on their own, also those without an id; a very
long text is tokenized part by part and cut into as many pieces as it needs.
Empty tables give empty results.  Only the named columns are read, so columns
of any other name may stand beside them.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, tokens

CAPACITY, END_ID = 2048, 0
#: Bins with at most this much room are emitted at once.
NEARLY_FULL = 8
#: Pieces a partition of the first round packs; later rounds join this many partitions.
PIECES_A_PARTITION, FAN_IN = 60_000, 8


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col="doc_id", text_col="text", ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32 (and ids, as 4-byte little-endian)."""
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokens.word_tokenizer(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for doc_id, own in zip(part.column(0).to_pylist(), tokenizer.ids(part.column(1).to_pylist())):
                    own += end
                    for piece, start in enumerate(range(0, len(own), 4 * capacity)):
                        data = own[start : start + 4 * capacity]
                        rows.append((doc_id, piece, start // 4, len(data) // 4, zlib.crc32(data), data))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(cols, kinds))[: 6 if ids else 5]], names[: 6 if ids else 5])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(cut, schema)


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each item, best fit and longest first; items of equal size in their order."""
    room: list[int] = []  # sorted rooms that some open bin has
    open_bins: dict[int, list[int]] = {}
    bins, made = [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        at = bisect_left(room, size)
        if at == len(room):
            own, left = made, capacity - size
            made += 1
        else:
            left = room[at]
            own = open_bins[left].pop()
            if not open_bins[left]:
                del open_bins[left], room[at]
            left -= size
        bins[i] = own
        if left > 0:
            if left not in open_bins:
                open_bins[left] = []
                insort(room, left)
            open_bins[left].append(own)
    return bins


ITEM = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,at:bigint>"
BIN = f"bin long, fill long, done boolean, items array<{ITEM}>"


def pack_round(level: int, capacity: int, last: bool):
    """Packs the bins of a partition; a bin is (fill, items)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        fills = table.column("fill").to_pylist()
        lists = table.column("items").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        own = np.asarray(best_fit(fills, capacity), np.int64)
        order = np.argsort(own, kind="stable")
        counts = np.bincount(own)
        taken = lists.take(pa.array(order))
        sizes = np.diff(taken.offsets.to_numpy())
        ends = np.cumsum(counts)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        offsets = np.concatenate([[0], upto[ends]]).astype(np.int32)
        sorted_fills = np.asarray(fills, np.int64)[order]
        through = np.cumsum(sorted_fills)
        fill = np.diff(np.concatenate([[0], through[ends - 1]]))
        # Where each joined bin begins in its new one moves its items along.
        base = through - sorted_fills - np.repeat(np.concatenate([[0], through[ends - 1][:-1]]), counts)
        values = taken.values.slice(taken.offsets[0].as_py(), int(upto[-1]))
        columns = dict(zip((f.name for f in values.type), values.flatten()))
        columns["at"] = pa.array(columns["at"].to_numpy() + np.repeat(base, sizes))
        values = pa.StructArray.from_arrays(list(columns.values()), list(columns))
        items = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        n = len(counts)
        done = np.ones(n, bool) if last else fill >= capacity - NEARLY_FULL
        number = (np.int64(level) << np.int64(56)) | (np.int64(part) << np.int64(32)) | np.arange(n, dtype=np.int64)
        out = pa.Table.from_arrays([pa.array(number), pa.array(fill), pa.array(done), items], ["bin", "fill", "done", "items"])
        yield from out.to_batches(max_chunksize=4096)

    return pack


def pack_best_fit(pieces: DataFrame, capacity: int = CAPACITY, fan_in: int = FAN_IN, a_partition: int = PIECES_A_PARTITION) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32), none longer than ``capacity``."""
    spark = pieces.sparkSession
    with scratch.bounded_batches(spark):
        pieces = scratch.stage(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    total = pieces.count()
    parts = max(1, -(-total // a_partition))
    # Dealt in turn, not by a key: repeated rows don't meet in one partition.
    bins = pieces.repartition(parts).select(
        F.lit(0).cast("long").alias("bin"), F.col("length").alias("fill"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("at"))).alias("items")
    )
    emitted, level, left = [], 0, None
    while True:
        packed = scratch.stage(bins.mapInArrow(pack_round(level, capacity, False), BIN), f"bins{level}")
        open_bins = packed.where("not done")
        # Only a bin at most half full can be joined whole with another.
        small = open_bins.agg(F.count(F.lit(1)), F.sum(F.when(F.col("fill") * 2 <= capacity, 1).otherwise(0))).first()
        count, small = small[0], small[1] or 0
        if parts == 1 or small < 2 or (left is not None and small >= left):
            emitted.append(packed)
            break
        emitted.append(packed.where("done"))
        left, parts, level = small, max(1, -(-parts // fan_in)), level + 1
        # Bins with room for the least small bin, dealt evenly; the others are as full as they can get.
        least = open_bins.agg(F.min("fill")).first()[0]
        hosts = F.col("fill") + least <= capacity
        emitted.append(open_bins.where(~hosts))
        bins = open_bins.where(hosts).repartition(parts, "bin").select("bin", "fill", "items")
    out = emitted[0]
    for more in emitted[1:]:
        out = out.unionByName(more)
    return out.select(F.col("bin").alias("sequence_id"), F.inline("items")).withColumnRenamed("at", "offset")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Documents, tokenized and cut, in as few sequences of at most ``capacity`` tokens as best fit finds."""
    vocabulary = vocabulary or tokens.vocabulary("word_bpe_49k.json")
    return pack_best_fit(cut_documents(docs, vocabulary, capacity, end_id), capacity)
