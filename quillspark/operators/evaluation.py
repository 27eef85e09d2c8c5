"""Evaluation: per-suite aggregates of scored traces, extraction metrics.

A scored trace has prompt_id, suite, score (judge), pass (nullable) and
sub_scores (map).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

FLAG_AT = 2.0


def mean(c) -> Column:
    """Average, 0.0 where there is nothing (AGG02)."""
    return F.coalesce(F.avg(c), F.lit(0.0))


def personality(scored: DataFrame) -> DataFrame:
    """Histogram by the integer part of the score (AGG03)."""
    return scored.groupBy(F.col("score").cast("int").cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def tool_use(scored: DataFrame) -> DataFrame:
    """Accuracy over traces to which the check applies (AGG05)."""
    return scored.agg(mean("score").alias("mean_score"), F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.col("pass").cast("int")), F.lit(0.0)).alias("accuracy"))


def triplets(scored: DataFrame) -> DataFrame:
    """Triplets of variants A, B, C by id prefix: complete ones, and those whose A and B pass; last row of an id wins (AGG06)."""
    base, variant = T.base_and_variant("prompt_id")
    last = scored.withColumns({"base": base, "variant": variant}).groupBy("base", "variant").agg(F.max_by(F.struct("pass", "score"), "seq").alias("r"))
    wide = last.groupBy("base").pivot("variant", ["A", "B", "C"]).agg(F.first("r"))
    whole = wide.where("A is not null and B is not null and C is not null")
    return whole.agg(
        F.count(F.lit(1)).alias("triplets"),
        mean(F.col("A.pass").eqNullSafe(F.lit(True)) .cast("int") * F.col("B.pass").eqNullSafe(F.lit(True)).cast("int")).alias("pass_rate"),
    )


def memory_handling(scored: DataFrame) -> DataFrame:
    """Mean judge score and count of all traces of a variant C that have one, beside the triplet figures (AGG06)."""
    last = F.col("prompt_id").endswith("-C") & F.col("score").isNotNull()
    c = scored.agg(mean(F.when(last, F.col("score"))).alias("mean_score"), F.count_if(last).alias("n"))
    # One row each.
    return c.crossJoin(F.broadcast(triplets(scored)))


def stability(scored: DataFrame) -> DataFrame:
    """Turns with a score above 2 over all scored turns, pooled (AGG07)."""
    values = F.map_values("sub_scores")
    return scored.agg(
        F.count(F.lit(1)).alias("conversations"), F.coalesce(F.sum(F.size(values)), F.lit(0)).cast("long").alias("turns"),
        F.coalesce(F.sum(F.size(F.filter(values, lambda x: x > 2))) / F.nullif(F.sum(F.size(values)), F.lit(0)), F.lit(0.0)).alias("mean_score"),
    )


def dimension_means(scored: DataFrame) -> DataFrame:
    """Mean of each sub-score (AGG04)."""
    return scored.select(F.explode("sub_scores").alias("dimension", "value")).groupBy("dimension").agg(F.avg("value").alias("mean"))


def report(scored: DataFrame, suites: list[str]) -> DataFrame:
    """Mean and count of each known suite, and the flags of all (AGG01, FLT26, SET09)."""
    known = scored.where(F.col("suite").isin(suites)).groupBy("suite").agg(mean("score").alias("mean_score"), F.count(F.lit(1)).alias("n"))
    return known


def flagged(scored: DataFrame) -> DataFrame:
    """Ids of traces that the judge scored 2 or less."""
    return scored.where(F.col("score") <= FLAG_AT).select("prompt_id").distinct()


def tool_check(calls: Column, expected: Column) -> Column:
    """Whether the calls fit what was expected; null where nothing was (FLT08)."""
    wiki = F.array(F.lit("search_knowledge"), F.lit("read_knowledge"))
    return F.when(expected == "wiki", F.arrays_overlap(calls, wiki)).when(expected == "delegate", F.array_contains(calls, "delegate")).when(expected == "none", F.size(calls) == 0)


def extraction_parts(predicted: Column, gold: Column) -> Column:
    """Score of two arrays of structs (character, text), the mean of four parts: equal length, equal character set, shares of equal texts and of equal characters over the gold length; 1 for equal arrays (AGG30).

    No lines where the other array has some share nothing: the reference divides by zero there.
    """
    n = F.nullif(F.size(gold), F.lit(0))
    pairs = F.slice(F.arrays_zip(predicted.alias("p"), gold.alias("g")), F.lit(1), F.least(F.size(predicted), F.size(gold)))
    share = lambda field: F.coalesce(F.size(F.filter(pairs, lambda z: z.p[field].eqNullSafe(z.g[field]))) / n, F.lit(0.0))
    names = lambda lines: F.array_sort(F.array_distinct(F.transform(lines, lambda x: x.character)))
    parts = (F.size(predicted) == F.size(gold)).cast("int") + (names(predicted) == names(gold)).cast("int") + share("text") + share("character")
    return F.when(predicted == gold, F.lit(1.0)).otherwise(parts / 4)


def diff_label(p_name: Column, p_text: Column, g_name: Column, g_text: Column) -> Column:
    """What a positional comparison says of one line (PRJ48)."""
    return (
        F.when(p_text.isNull(), "Missing").when(g_text.isNull(), "Extra")
        .when((p_name == g_name) & (p_text == g_text), "Perfect").when(p_text == g_text, "Text OK, wrong character")
        .when(p_name == g_name, "Character OK, wrong text").otherwise("Complete mismatch")
    )
