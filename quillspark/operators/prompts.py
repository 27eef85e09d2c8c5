"""Literal prompt and evaluation rows (SRC28): small tables of topics and suites, multiplied out by the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of hand-written prompts: name, what the user wants, tools.
MANUAL = [
    ("greeting", "says hello", ""), ("lookup", "asks for a fact", "search_knowledge"), ("reading", "asks to read a passage", "search_knowledge,read_knowledge"),
    ("recall", "asks about an earlier talk", "recall"), ("remember", "tells something to keep", "remember"), ("task", "asks for work to be done", "delegate"),
    ("mixed", "asks for a fact and a memory", "search_knowledge,recall"), ("refusal", "asks for what is not known", "search_knowledge"),
    ("smalltalk", "chats about the day", ""), ("farewell", "takes leave", ""),
]
#: Evaluation suites: name, prompts, variants, tool use that is expected.
SUITES = [
    ("personality", 20, "", ""), ("social_reasoning", 12, "", ""), ("tool_use", 15, "", "wiki"), ("memory_handling", 10, "A,B,C", "none"),
    ("stability", 8, "", ""), ("language", 10, "en,it", ""),
]
#: Scenarios of the memory corpus: part, number, age in days of the first and step between them.
CORPUS = [("roleplay", 5, 0, 3), ("casual", 5, 1, 7)]


def manual_prompts(spark: SparkSession, each: int = 5) -> DataFrame:
    """(id, kind, user_summary, tools): ``each`` prompts of every kind."""
    rows = spark.createDataFrame(MANUAL, "kind string, wants string, tools string").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(each))))
    tools = F.filter(F.split("tools", ","), lambda x: x != "")
    return rows.select(F.format_string("%s-%03d", "kind", "n").alias("id"), "kind", F.concat(F.lit("The user "), "wants").alias("user_summary"), tools.alias("tools"))


def suite_prompts(spark: SparkSession) -> DataFrame:
    """(id, suite, variant, expected_tool_use): numbered prompts of every suite, once for each of its variants."""
    rows = spark.createDataFrame(SUITES, "suite string, n int, variants string, expected_tool_use string")
    rows = rows.withColumn("i", F.explode(F.expr("sequence(1, n)"))).withColumn("variant", F.explode(F.split("variants", ",")))
    ident = F.concat(F.format_string("%s-%03d", "suite", "i"), F.when(F.col("variant") != "", F.concat(F.lit("-"), "variant")).otherwise(""))
    return rows.select(ident.alias("id"), "suite", "variant", "expected_tool_use")


def corpus_scenarios(spark: SparkSession) -> DataFrame:
    """(key, part, days_ago): the seeds of the memory corpus."""
    rows = spark.createDataFrame(CORPUS, "part string, n int, first int, step int").withColumn("i", F.explode(F.expr("sequence(0, n - 1)")))
    return rows.select(F.format_string("%s-%d", "part", "i").alias("key"), "part", (F.col("first") + F.col("i") * F.col("step")).alias("days_ago"))
