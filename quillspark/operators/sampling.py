"""Reproducible sampling by hashed uniforms: independent of partitioning, never rand()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import uniform


def sample(df: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """n rows without replacement, or all (TOP10): those of least uniform."""
    return df.orderBy(uniform(seed, key), key).limit(n)


def weighted_sample(df: DataFrame, n: int, seed: str, key: str, weight: Column) -> DataFrame:
    """n rows without replacement by weight: largest u ** (1 / w) (TOP11)."""
    return df.orderBy(F.pow(uniform(seed, key), 1 / weight).desc(), key).limit(n)


def choose_one(df: DataFrame, group: str, key: str, seed: str, prefer: Column) -> DataFrame:
    """One row a group, among the preferred if there are any (TOP12)."""
    order = F.struct((~prefer).cast("int").alias("a"), uniform(seed, key).alias("u"), F.col(key).alias("k"))
    return df.groupBy(group).agg(F.min_by(F.struct("*"), order).alias("r")).select("r.*")


def split(key: str, seed: str, share: float) -> Column:
    """True for the training share (TOP14)."""
    return uniform(seed, key) < share


def round_robin(items: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n draws without replacement, shuffled anew each time the items run out (WIN17); items are few."""
    size = items.agg(F.count(F.lit(1)).alias("size"))
    epochs = size.select(F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.lit(n) / F.col("size")).cast("int") - 1, F.lit(0)))).alias("epoch"), "size")
    drawn = items.join(epochs).withColumn("u", uniform(seed, F.concat_ws("|", F.col("epoch").cast("string"), F.col(key).cast("string"))))
    drawn = drawn.withColumn("i", F.col("epoch") * F.col("size") + F.row_number().over(W.partitionBy("epoch").orderBy("u", key)) - 1)
    return drawn.where(F.col("i") < n).select(F.col("i").cast("long").alias("i"), key)
