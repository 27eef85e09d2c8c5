"""Jump consistent hashing: stable keys to shards without a ring table.

Nulls, ties and repeats: a null key is a key of its own; a null text has no
bytes; repeated rows are rows like any other and get slots of their own.  An
empty table gives an empty result.  Only the named columns are read, so extra
columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import scratch

#: Multiplier of the generator in the published jump hash.
JUMP_LCG = 2862933555777941757
NULL_KEY = -0x61C8864680B583EB


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every key; growing ``shards`` by one moves keys only into the new shard."""
    state = mix64(np.asarray(keys))
    shard, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = ahead[live]
        state[live] = state[live] * np.uint64(JUMP_LCG) + np.uint64(1)
        steps = np.float64(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = np.minimum((shard[live] + 1) * steps, np.float64(1 << 62)).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard.astype(np.int32)


def jump_column(key, shards: int):
    """Column form of :func:`jump` for a long key column."""

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards))

    return shard_of(F.coalesce(F.col(key) if isinstance(key, str) else key, F.lit(NULL_KEY)).cast("long"))


def number_within(df: DataFrame, group: str, order: list[str], into: str) -> DataFrame:
    """Gapless numbers from 0 within each ``group``, in order of (hash bucket of ``order``, ``order``).

    A group may hold any share of the rows: it is cut into hash buckets that are
    sorted apart, and only a table of groups x buckets counts (bounded by the
    number of shuffle partitions) is broadcast.
    """
    buckets = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(group, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = W.partitionBy(group, "__bucket").orderBy(*order)
    return (
        rows.withColumn("__rank", F.row_number().over(inside))
        .join(F.broadcast(sizes), [group, "__bucket"])
        .withColumn(into, (F.col("__before") + F.col("__rank") - 1).cast("long"))
        .drop("__bucket", "__rank", "__before")
    )


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards 0..shards-1 by key, with a gapless slot in each shard and the shard after one is appended."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_column(id_col, shards).alias("shard"),
        jump_column(id_col, shards + 1).alias("grown_shard"),
    )
    # Written once: the slots take two passes.
    out = number_within(scratch.stage(rows, "shards"), "shard", ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
