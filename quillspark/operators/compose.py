"""Prompt composition: products of dimensions, exclusions, memories by tag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def product(first: DataFrame, *more: DataFrame) -> DataFrame:
    """All combinations of small dimension tables (JON15)."""
    out = first
    for other in more:
        out = out.crossJoin(F.broadcast(other))
    return out


def excluding(rows: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose pair of values is not excluded (FLT05)."""
    return rows.join(pairs, keys, "left_anti")


def relevant(profiles: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs of a profile and an entry that share a tag, and the character where the profile has one (FLT04, JON14).

    Tags are exploded to an equi-join: no nested loop over all pairs.
    """
    p = profiles.select("profile_id", F.col("character").alias("__c"), F.explode(F.array_distinct("tags")).alias("__tag"))
    e = entries.select("entry_id", "character", "days_ago", F.explode(F.array_distinct("tags")).alias("__tag"))
    both = p.join(e, "__tag").where(F.col("__c").isNull() | F.col("__c").eqNullSafe(F.col("character")))
    return both.select("profile_id", "entry_id", "days_ago").distinct()
