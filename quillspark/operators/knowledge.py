"""Knowledge and memory tools over DataFrames: search, read, recall, remember, delegate (UDF05).

Each tool takes a table of calls, a row each, so that a batch of agents is
served by one plan; the answers are the texts that an agent reads, whose
wording is fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import sinks
from . import markdown, search


def index(files: DataFrame) -> DataFrame:
    """Segments of Markdown files with the text that is searched and their place in the index (SRC15, PRJ33)."""
    place = F.concat_ws("#", "file_path", F.lpad(F.col("segment").cast("string"), 9, "0"))
    return markdown.segments(files).withColumn("searched", F.concat_ws(" ", F.array_join("section_path", " "), "content")).withColumn("place", place)


def hits(segments: DataFrame, queries: DataFrame, k: int = 5, key: str = "place", searched: str = "searched") -> DataFrame:
    """(query_id, rank, key, score) of each query's k best entries with a score above 0, the later entry first among equals (TOP01, TOP02)."""
    return search.bm25l_best(segments, key, F.col(searched), queries, k).where("score > 0")


def search_knowledge(segments: DataFrame, calls: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, answer) for calls (query_id, query): the matches with id, path, snippet and size."""
    rows = hits(segments, calls.where(F.btrim("query") != ""), k).join(segments, "place")
    path = F.array_join(F.concat(F.array("file_path"), F.col("section_path")), " > ")
    entry = F.concat_ws("\n", F.concat("rank", F.lit(". ["), "segment_id", F.lit("]")), F.concat(F.lit("   Path: "), path), F.concat(F.lit("   Snippet: "), F.concat(F.btrim(F.left("content", F.lit(200)), F.lit(" \n\t\r")), F.when(F.length("content") > 200, "...").otherwise(""))), F.concat(F.lit("   (~"), "token_count", F.lit(" tokens)")))
    found = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", entry.alias("e")))), lambda x: x["e"]), "\n\n").alias("body"))
    told = F.concat(F.lit("Found "), "n", F.lit(" matches for '"), "query", F.lit("':\n\n"), "body", F.lit("\n"))
    answer = (
        F.when(F.btrim("query") == "", F.lit("Error: Please provide keywords to search for"))
        .when(F.col("n").isNull(), F.concat(F.lit("No entries found for '"), "query", F.lit("'")))
        .otherwise(told)
    )
    return calls.join(found, "query_id", "left").select("query_id", answer.alias("answer"))


def read_knowledge(segments: DataFrame, calls: DataFrame) -> DataFrame:
    """(call_id, answer) for calls (call_id, segment_id): a segment's path, size and whole content; of equal ids the last segment."""
    last = segments.groupBy("segment_id").agg(F.max_by(F.struct("file_path", "section_path", "token_count", "content"), "place").alias("s"))
    path = F.array_join(F.concat(F.array("s.file_path"), F.col("s.section_path")), " > ")
    text = F.concat(F.lit("Segment: "), path, F.lit("\nSize: ~"), "s.token_count", F.lit(" tokens\n\n"), "s.content")
    answer = F.when(F.btrim("segment_id") == "", F.lit("Error: Please provide a segment ID")).when(F.col("s").isNull(), F.concat(F.lit("Error: Segment '"), "segment_id", F.lit("' not found"))).otherwise(text)
    return calls.join(last, "segment_id", "left").select("call_id", answer.alias("answer"))


def recall(bank: DataFrame, calls: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, answer) over memories (key, value, days_ago): the best matches with their age."""
    entries = bank.withColumn("searched", F.concat_ws(" ", "key", "value"))
    rows = hits(entries, calls, k, key="key").join(bank, "key")
    line = F.concat(F.lit("["), T.relative_time("days_ago"), F.lit("] "), "key", F.lit(": "), "value")
    found = rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    return calls.join(found, "query_id", "left").select("query_id", F.coalesce(F.when(F.btrim("query") == "", F.lit("Error: Please provide a search query")), "body", F.lit("No matching memories found.")).alias("answer"))


def remember(calls: DataFrame, path: str, eval_mode: bool = True) -> DataFrame:
    """(call_id, answer) for calls (call_id, key, value); in eval mode nothing is stored (STM04), else valid entries are appended as new."""
    bad = F.when(F.btrim(F.coalesce("key", F.lit(""))) == "", "Error: Please provide a key").when(F.btrim(F.coalesce("value", F.lit(""))) == "", "Error: Please provide a value")
    if not eval_mode:
        sinks.json_lines(calls.where(bad.isNull()).select(F.btrim("key").alias("key"), F.btrim("value").alias("value"), F.lit(0).cast("long").alias("days_ago")), path, append=True)
    return calls.select("call_id", F.coalesce(bad, F.lit("Memory stored.")).alias("answer"))


def delegate(calls: DataFrame) -> DataFrame:
    """(call_id, answer) for calls (call_id, task): an acknowledgement."""
    return calls.select("call_id", F.concat(F.lit("Task delegated: "), "task", F.lit("\nThe specialist is working on it. Result will be provided when ready.")).alias("answer"))


class Bank:
    """A bank of memories in a folder, whose index is built on demand and again once the bank has grown (STM03)."""

    def __init__(self, spark, path: str, read):
        self.spark, self.path, self.read = spark, path, read
        self.indexed, self.built, self.index = -1, 0, None

    def entries(self) -> DataFrame:
        rows = self.read(self.spark, self.path)
        size = rows.count()
        if size != self.indexed:
            self.index, self.indexed, self.built = rows, size, self.built + 1
        return self.index

    def recall(self, calls: DataFrame, k: int = 5) -> DataFrame:
        return recall(self.entries(), calls, k)

