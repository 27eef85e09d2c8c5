"""Ordered-sequence operators: sessions, runs, trims, prefixes.

All work per partition key with an explicit order; no window is global.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _w(keys, order):
    return W.partitionBy(*keys).orderBy(*order)


def sessions_by_flag(df: DataFrame, keys, order, flag: Column, into: str = "session") -> DataFrame:
    """A new session at each flagged row but the first of its key; sessions count from 0 (WIN01)."""
    w = _w(keys, order)
    first = F.row_number().over(w) == 1
    starts = df.withColumn("__start", F.when(~first & F.coalesce(flag, F.lit(False)), 1).otherwise(0))
    return starts.withColumn(into, F.sum("__start").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__start")


def sessions_by_gap(df: DataFrame, keys, position: str, into: str = "session", gap: int = 1) -> DataFrame:
    """A new session where the position does not follow its predecessor (WIN03)."""
    w = _w(keys, [position])
    starts = df.withColumn("__start", F.when(F.col(position) - F.lag(position).over(w) > gap, 1).otherwise(0))
    return starts.withColumn(into, F.sum("__start").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__start")


def present_runs(df: DataFrame, keys, position: str, into: str = "run") -> DataFrame:
    """Runs of consecutive positions, named by position minus rank (WIN04)."""
    return df.withColumn(into, F.col(position) - F.row_number().over(_w(keys, [position])))


def runs(df: DataFrame, keys, order, value: str, into: str = "run") -> DataFrame:
    """Numbers the runs of equal values (WIN05, WIN06)."""
    w = _w(keys, order)
    starts = df.withColumn("__start", F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1), 0).otherwise(1))
    return starts.withColumn(into, F.sum("__start").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__start")


def ordered_text(order: str, text: str, sep: str = "\n") -> Column:
    """Texts of a group joined in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), sep)


def merge_runs(df: DataFrame, keys, order: str, value: str, text: str) -> DataFrame:
    """One row a run of equal values: its texts joined by line ends (WIN05, AGG25)."""
    return (
        runs(df, keys, [order], value).groupBy(*keys, "run", value)
        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("merged"), ordered_text(order, text).alias(text))
    )


def trim_to(df: DataFrame, keys, order: str, is_target: Column) -> DataFrame:
    """Rows from one before the first target to the last one (WIN08)."""
    w = W.partitionBy(*keys)
    ranked = df.withColumn("__at", F.row_number().over(_w(keys, [order])))
    marked = ranked.withColumns({"__lo": F.min(F.when(is_target, F.col("__at"))).over(w), "__hi": F.max(F.when(is_target, F.col("__at"))).over(w)})
    return marked.where("__at between __lo - 1 and __hi").drop("__at", "__lo", "__hi")


def scene_index(scenes: DataFrame, base, order) -> DataFrame:
    """Number of a scene among those of one base, from 0 (WIN02)."""
    return scenes.withColumn("scene_index", (F.row_number().over(_w(base, order)) - 1).cast("long"))


def numbered(df: DataFrame, keys, order: str, into: str, width: int = 1 << 16) -> DataFrame:
    """Rows numbered from 1 within a key by a whole number ``order``.

    Rows are sorted in blocks of ``width`` values, and blocks begin where those
    before them end, so no task holds all rows of a key.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = df.withColumn("__block", F.floor(F.col(order) / width))
    counts = rows.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(counts.select(*keys, "__block", before.alias("__before")), [*keys, "__block"])
    number = F.row_number().over(W.partitionBy(*keys, "__block").orderBy(order))
    return rows.withColumn(into, (F.col("__before") + number).cast("long")).drop("__block", "__before")


def last_non_empty(df: DataFrame, keys, order, value: str, n: int, into: str) -> DataFrame:
    """The last n non-empty values before each row, in order (WIN10): short lists of the non-empty rows, carried on to the next ones."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    full = F.coalesce(F.col(value) != "", F.lit(False))
    own = F.collect_list(value).over(_w([*keys, "__full"], order).rowsBetween(1 - n, 0))
    seen = df.withColumn("__full", full).withColumn("__own", F.when(F.col("__full"), own))
    found = F.last("__own", ignorenulls=True).over(_w(keys, order).rowsBetween(W.unboundedPreceding, -1))
    return seen.withColumn(into, F.coalesce(found, F.array().cast("array<string>"))).drop("__full", "__own")


def carry_forward(df: DataFrame, keys, order, value: str, into: str) -> DataFrame:
    """The last known value before or at each row (WIN13)."""
    return df.withColumn(into, F.last(value, ignorenulls=True).over(_w(keys, order).rowsBetween(W.unboundedPreceding, 0)))


def spread(df: DataFrame, keys, order, span: int = 60, into: str = "days_ago") -> DataFrame:
    """Positions spread evenly over a span: i * span // max(n - 1, 1) (WIN15)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    rows = numbered(df, keys, order, "__at").join(sizes, list(keys))
    return rows.withColumn(into, F.floor((F.col("__at") - 1) * span / F.greatest(F.col("__size") - 1, F.lit(1)))).drop("__at", "__size")


def cycle(items: Column, i: Column, default: str) -> Column:
    """Items in turn, or a default where there are none (WIN16)."""
    return F.when(F.size(items) > 0, F.try_element_at(items, (F.pmod(i, F.greatest(F.size(items), F.lit(1))) + 1).cast("int"))).otherwise(F.lit(default))
