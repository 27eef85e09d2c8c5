"""Claim ledger: claims are a dimension, evidence is a table of signed facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# The sections of a ledger and their order in documents.
SECTIONS = ("identity", "psychology", "capabilities", "interests", "relationships", "history")


def valid_path(path: Column) -> Column:
    """Two to four non-empty parts, the first a known section (FLT06)."""
    parts = F.split(path, "/")
    return F.size(parts).between(2, 4) & parts[0].isin(*SECTIONS) & F.forall(parts, lambda p: F.trim(p) != "")


def path_prefix(path: Column, n: int) -> Column:
    """The first n parts of a path (PRJ28)."""
    return F.array_join(F.slice(F.split(path, "/"), 1, n), "/")


def scope(path: Column) -> Column:
    """Scope of a claim by the beginning of its path (PRJ27)."""
    return F.when(path.startswith("relationships/"), "relationship").when(path.startswith("history/"), "episode").otherwise("general")


def apply_events(events: DataFrame) -> DataFrame:
    """Evidence facts of an event log (claim_id, scene_id, kind, seq): one a claim, scene and kind, the first (STM07)."""
    return events.groupBy("claim_id", "scene_id", "kind").agg(F.min("seq").alias("seq"))


def support(facts: DataFrame) -> DataFrame:
    """Supporting less contradicting evidence of each claim (AGG14)."""
    return facts.groupBy("claim_id").agg(
        F.sum(F.when(F.col("kind") == "support", 1).otherwise(-1)).alias("support"),
        F.count_if(F.col("kind") == "contradict").alias("contradicting"),
    )


def merge_ordered(df: DataFrame, group: str, key: str, order: str, into: str) -> DataFrame:
    """Distinct keys of a group in order of their first occurrence (AGG26)."""
    first = df.groupBy(group, key).agg(F.min(order).alias("__o"))
    return first.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("__o", key))), lambda x: x[key]).alias(into))


def refine(facts: DataFrame) -> DataFrame:
    """Contradicting evidence of claims becomes supporting (ITR02)."""
    return facts.withColumn("kind", F.lit("support"))


def condense(claims: DataFrame, levels=(3, 2, 1)) -> DataFrame:
    """Passes over path prefixes: groups of two and more claims become one, that of most support (ITR01).

    A pass that finds no group leaves the claims as they are.  Evidence counts
    add up; the condensed claim's scope is reset to general.
    """
    for n in levels:
        grouped = claims.withColumn("__p", path_prefix(F.col("path"), n))
        out = grouped.groupBy("__p").agg(
            F.count(F.lit(1)).alias("__n"), F.max_by(F.struct("claim_id", "text", "path", "scope"), F.struct("support", -F.col("claim_id"))).alias("r"), F.sum("support").alias("support"),
        )
        claims = out.select(
            "r.claim_id", "r.text", F.when(F.col("__n") > 1, F.col("__p")).otherwise(F.col("r.path")).alias("path"),
            F.when(F.col("__n") > 1, F.lit("general")).otherwise(F.col("r.scope")).alias("scope"), "support",
        )
    return claims


def by_section(claims: DataFrame) -> DataFrame:
    """Claims with their rank in their section, by support (TOP04)."""
    section = F.split("path", "/")[0]
    w = W.partitionBy("section").orderBy(F.desc("support"), "claim_id")
    return claims.withColumn("section", section).withColumn("rank", F.row_number().over(w).cast("long"))


def document(claims: DataFrame, least: int) -> DataFrame:
    """Section texts of claims with enough support, in section order (ITR04)."""
    line = F.concat(F.lit("- "), F.when(F.col("scope") != "general", F.concat(F.lit("("), F.col("scope"), F.lit(") "))).otherwise(F.lit("")), F.col("text"))
    kept = by_section(claims).where(F.col("support") >= least).withColumn("line", line)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x.line), "\n")
    order = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    return kept.groupBy("section").agg(text.alias("body")).withColumn("ord", order.cast("long"))


class Ledger:
    """A ledger as two frames, with the operations that tools offer (UDF06); each returns a new ledger.

    claims: claim_id, text, path, scope.  facts: claim_id, scene_id, kind, quote, seq.
    """

    def __init__(self, claims: DataFrame, facts: DataFrame):
        self.claims, self.facts = claims, facts

    def listed(self, section: str | None = None) -> DataFrame:
        """Claims with their support, those of a section or all."""
        own = self.claims if section is None else self.claims.where(F.split("path", "/")[0] == section)
        return own.join(support(self.facts), "claim_id", "left").withColumns({"support": F.coalesce("support", F.lit(0).cast("long")), "contradicting": F.coalesce("contradicting", F.lit(0).cast("long"))})

    def viewed(self, claim_id: int) -> DataFrame:
        """The evidence of one claim."""
        return self.facts.where(F.col("claim_id") == claim_id).orderBy("seq")

    def add(self, claim_id: int, text: str, path: str) -> Ledger:
        row = self.claims.sparkSession.createDataFrame([(claim_id, text, path)], "claim_id long, text string, path string")
        row = row.where(valid_path(F.col("path"))).withColumn("scope", scope(F.col("path")))
        return Ledger(self.claims.unionByName(row), self.facts)

    def evidence(self, claim_id: int, scene_id: int, kind: str, seq: int, quote: str | None = None) -> Ledger:
        """Support or contradict; a second event of one claim, scene and kind is refused whole, quote and all."""
        row = self.facts.sparkSession.createDataFrame([(claim_id, scene_id, kind, quote, seq)], "claim_id long, scene_id long, kind string, quote string, seq long")
        new = row.join(self.facts, ["claim_id", "scene_id", "kind"], "left_anti").join(self.claims, "claim_id", "left_semi")
        return Ledger(self.claims, self.facts.unionByName(new.select(*self.facts.columns)))

    def refined(self, claim_id: int, text: str) -> Ledger:
        own = F.col("claim_id") == claim_id
        return Ledger(self.claims.withColumn("text", F.when(own, F.lit(text)).otherwise(F.col("text"))), self.facts.withColumn("kind", F.when(own, F.lit("support")).otherwise(F.col("kind"))))
