"""Rows that can't have any of some keys, told by a bitmap of bounded size before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the map, 64 to a row: 262144 rows of two longs, some 12 MB in memory, at most, however many keys there are.
BITS = 1 << 24


def marked(rows: DataFrame, keys: DataFrame, on: list[str], bits: int = BITS) -> DataFrame:
    """``rows`` with a boolean column ``maybe``: false only where no key is equal.

    The map is exact about absence whatever the number of keys; with very many
    it passes over fewer rows.  ``rows`` have no columns part, at, map or maybe.
    """
    bit = F.pmod(F.xxhash64(*on), F.lit(bits))
    place = {"part": F.shiftright(bit, 6), "at": bit.bitwiseAND(F.lit(63)).cast("int")}
    maps = keys.select(*(c.alias(name) for name, c in place.items())).groupBy("part").agg(F.expr("bit_or(shiftleft(1L, at))").alias("map"))
    told = rows.withColumns(place).join(F.broadcast(maps), "part", "left")
    return told.withColumn("maybe", F.expr("coalesce(shiftright(map, at) & 1 = 1, false)")).drop("part", "at", "map")


def without(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows that have none of the ``keys``; only those that may have one are shuffled."""
    told = marked(rows, keys, on)
    return told.where(~F.col("maybe")).unionByName(told.where("maybe").join(keys, on, "left_anti")).drop("maybe")


def only(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows that may have one of the ``keys``: all that have, and few others; for an exact join to take."""
    return marked(rows, keys, on).where("maybe").drop("maybe")
