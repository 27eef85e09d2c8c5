"""Queries of pluggable generation and versioned documents, with deterministic backends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import backend as B
from ..functions import text as T
from ..operators import agents, versions
from ..sources import sinks, workspace
from .base import query, table

SCENARIOS = "CASE WHEN contains(source, '1') THEN 'search_knowledge,read_knowledge' WHEN contains(source, '2') THEN 'delegate' ELSE 'recall' END"


@query("prj29_scenario_maps", f"SELECT doc_id, {SCENARIOS} AS tools FROM documents")
def prj29(spark, d):
    """Also JON16."""
    s = F.col("source")
    return table(spark, d, "documents").select("doc_id", F.when(s.contains("1"), "search_knowledge,read_knowledge").when(s.contains("2"), "delegate").otherwise("recall").alias("tools"))


@query("str10_templates", "SELECT doc_id, 'You talk ' || lang || ' with ' || source || ' for ' || (doc_id % 4 + 3) || ' turns.' AS prompt FROM documents")
def str10(spark, d):
    """Also SRC17 and SNK13: a one-line template file read back as a literal."""
    path = workspace.fresh(spark, "template")
    spark.range(1).select(F.lit("You talk %s with %s for %d turns.").alias("value")).write.text(path)
    template = spark.read.text(path).first()[0]
    return table(spark, d, "documents").select("doc_id", F.format_string(template, "lang", "source", F.col("doc_id") % 4 + 3).alias("prompt"))


@query("src21_filtered_walk", "SELECT lang FROM documents WHERE lang NOT IN ('de') GROUP BY lang")
def src21(spark, d):
    """Also SRC22 and SNK05: a walk over written folders that skips some."""
    path = workspace.fresh(spark, "walk")
    sinks.by_value(table(spark, d, "documents").select("doc_id", "lang"), path, "lang")
    rows = spark.read.option("recursiveFileLookup", True).schema("doc_id long").json(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"lang=([a-z]+)", 1).alias("lang"))
    return rows.where(~F.col("lang").isin("de")).distinct()


@query("udf01_judge", "SELECT conv_id, turn, CASE WHEN length(text) % 17 <> 0 THEN (1 + length(text) % 5)::DOUBLE END AS score, CASE WHEN length(text) % 17 <> 0 THEN length(text) || ' characters' END AS justification FROM conversations WHERE role = 'assistant' AND text <> ''")
def udf01(spark, d):
    """A deterministic judge behind the generation function; a reply that can't be read gives nulls."""
    turns = table(spark, d, "conversations").where("role = 'assistant' and text <> ''")
    return turns.select("conv_id", "turn", agents.verdict(agents.RubricJudge(), "personality", F.col("text"), agents.RUBRIC).alias("j")).select("conv_id", "turn", "j.*")


def remember(key: str, value: str) -> str:
    """Stores a memory."""
    return f"stored {key}={value}"


@query("udf02_tool_loop", "SELECT conv_id, 'done' AS text, 2 AS calls, 'stored k=v' AS first FROM conversations WHERE turn = 0")
def udf02(spark, d):
    """Also UDF05: tools are served until a plain text comes; an unknown tool gives an error text."""
    script = B.Scripted([B.Reply(calls=[("remember", {"key": "k", "value": "v"})]), B.Reply(calls=[("nope", {})]), B.Reply("done")])
    turns = table(spark, d, "conversations").where("turn = 0")
    r = turns.withColumn("r", B.generate(script, F.lit(""), F.col("text"), B.Tools({"remember": remember})))
    return r.select("conv_id", "r.text", F.size("r.calls").alias("calls"), F.col("r.calls")[0].result.alias("first"))


@query("udf08_compact_memories", "SELECT source, 'Compact. ' || CAST(sum(1 + length(text) - length(replace(text, chr(10), ''))) AS BIGINT) || ' lines, ' || CAST(sum(length(text) + 3) - 1 AS BIGINT) || ' characters' AS text FROM documents GROUP BY source")
def udf08(spark, d):
    """A group's rows rendered in order, then one generation a group."""
    return agents.rewritten(table(spark, d, "documents"), agents.Listing(), "Compact.", "source", "doc_id", "text").select("source", "text")


@query("jon22_vocabulary_map", "WITH w AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM documents) SELECT length(w) <= 4 AS exact, count(*) AS n, round(avg((length(w) + 3) // 4), 6) AS expansion FROM w GROUP BY 1")
def jon22(spark, d):
    """Words mapped to their pieces of four characters, with coverage."""
    words = table(spark, d, "documents").select(F.explode(T.tokens("text")).alias("w")).distinct()
    pieces = words.select("w", F.expr("transform(sequence(1, length(w), 4), i -> substring(w, i, 4))").alias("p"))
    return pieces.groupBy((F.size("p") == 1).alias("exact")).agg(F.count("*").alias("n"), F.round(F.avg(F.size("p")), 6).alias("expansion"))


@query("prj34_document_tree", "SELECT page_id, unnest(range(7)) AS ord, unnest([1, 0, 2, 0, 3, 0, 2]) AS level, unnest(['', 'T', 'T', 'T/' || url, 'T/' || url, 'T/' || url || '/s', 'T']) AS parent, unnest(['T', NULL, url, NULL, 's', NULL, 'end']) AS header, unnest([NULL, 'a', NULL, 'b', NULL, 'c', NULL]) AS line FROM pages")
def prj34(spark, d):
    docs = table(spark, d, "pages").select("page_id", F.concat(F.lit("# T\na\n## "), F.col("url"), F.lit("\nb\n### s\nc\n## end")).alias("text"))
    return versions.tree(docs, "page_id", "text").select("page_id", F.col("ord").cast("long").alias("ord"), "level", F.array_join("parent_path", "/").alias("parent"), "header", "line")


@query("snk11_version_diffs", "SELECT conv_id, turn, md5(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn)) AS hash FROM conversations")
def snk11(spark, d):
    """Conversations as growing documents: each turn is a version, kept as a diff to the one before and made again from the diffs."""
    from pyspark.sql.window import Window as W

    so_far = F.array_join(F.collect_list("text").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)), "\n")
    v = table(spark, d, "conversations").select("conv_id", "turn", so_far.alias("text"))
    path = workspace.fresh(spark, "diffs")
    versions.diffs(v, "conv_id", "turn", "text").select("conv_id", "turn", "diff").write.parquet(path)
    return versions.replayed(spark.read.parquet(path), "conv_id", "turn").select("conv_id", "turn", F.md5("text").alias("hash"))


def budget_sql(passes: int = 5, budget: int = 100) -> str:
    count = "len(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) * 13 // 10"
    rows = "SELECT doc_id, text FROM documents"
    for _ in range(passes):
        rows = f"SELECT doc_id, CASE WHEN {count} > {budget} THEN left(text, length(text) // 2) ELSE text END AS text FROM ({rows})"
    return f"SELECT doc_id, {count} AS tokens, md5(text) AS hash FROM ({rows})"


@query("itr05_token_budget", budget_sql())
def itr05(spark, d):
    """Texts over the budget are shortened again, five times at most."""
    half = lambda c: F.left(c, F.floor(F.length(c) / 2).cast("int"))
    out = versions.condense_to_budget(table(spark, d, "documents"), "text", 100, half)
    return out.select("doc_id", T.token_estimate("text").alias("tokens"), F.md5("text").alias("hash"))
