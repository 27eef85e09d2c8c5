"""Record readers: explicit schemas, strict or tolerant, partition values from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "struct<role:string,content:string,thinking:string,name:string>"
# Record layouts (survey 1.4).
MEMORY = "key string, value string, days_ago long"
MEMORY_CORPUS = f"{MEMORY}, tags array<string>, archetype string, character string"
PROMPT = f"id string, messages array<{MESSAGE}>, user_summary string, tools array<string>"
TRACE = f"id string, memory_context string, user_summary string, messages array<{MESSAGE}>"
EVAL_TRACE = f"prompt_id string, suite string, model string, messages array<{MESSAGE}>, thinking string"
DIALOGUE = "struct<character:string,line:string,tone:string,speech_act:string>"
PAGE = f"summary string, last_event string, panels array<struct<is_new_scene:boolean,description:string,caption_text:string,visual_cues:array<string>,dialogues:array<{DIALOGUE}>>>"


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a bad line fails the read, blank lines are skipped (SRC01-SRC03)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def memory_bank(spark: SparkSession, path: str) -> DataFrame:
    """Memory entries; an unknown age is 0 (SRC04)."""
    return strict(spark, path, MEMORY).withColumn("days_ago", F.coalesce("days_ago", F.lit(0).cast("long")))


def tolerant_ids(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Distinct ids of the readable lines that have one; the key may be nested (SRC08-SRC10)."""
    root, _, inner = key.partition(".")
    schema = f"{root} " + (f"struct<{inner}:string>" if inner else "string") + ", __bad string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(path)
    return rows.where(F.col("__bad").isNull()).select(F.col(key).alias("id")).where("id is not null").distinct()


def stem(path: Column | None = None) -> Column:
    """File name without folder and ending."""
    return F.regexp_extract(F.col("_metadata.file_name") if path is None else path, r"([^/]+?)(\.[A-Za-z]+)*$", 1)


def by_suite(spark: SparkSession, root: str, schema: str, suites: list[str] | None = None) -> DataFrame:
    """JSON lines below ``suite=...`` folders: a suite filter prunes partitions (SRC05, SRC07)."""
    rows = spark.read.schema(f"{schema}, suite string" if "suite " not in schema else schema).option("basePath", root).json(root)
    return rows if suites is None else rows.where(F.col("suite").isin(suites))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last by an order (SRC06, SRC11, SRC19)."""
    return rows.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("__r")).select("__r.*")


def page_numbers(rows: DataFrame, path: str = "path") -> DataFrame:
    """Issue and page number of ``issue/page_NNN.json`` (SRC12, SRC20)."""
    return rows.withColumns({"issue": F.regexp_extract(path, r"([^/]+)/page_\d+[^/]*$", 1), "page_num": F.regexp_extract(path, r"page_(\d+)", 1).cast("long")})


def pages(spark: SparkSession, root: str) -> DataFrame:
    """Page files of a folder tree, one JSON document each (SRC12, SRC13, SRC16); unreadable ones are left out."""
    rows = spark.read.schema(PAGE + ", __bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").option("recursiveFileLookup", True).json(root)
    return page_numbers(rows.where("__bad is null").drop("__bad").withColumn("path", F.col("_metadata.file_path"))).drop("path")


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """Markdown files of a folder tree, one row each (SRC15, SRC21)."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content"))


def csv_json(spark: SparkSession, path: str, cells: dict[str, str], schema: str) -> DataFrame:
    """CSV whose cells hold JSON (SRC18)."""
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.withColumns({c: F.from_json(c, s) for c, s in cells.items()})


def category_tree(edges: DataFrame, root: str, depth: int = 10) -> DataFrame:
    """Paths from a root over (parent, child) edges, level by level, at most ``depth`` deep (SRC25)."""
    level = edges.where(F.col("parent") == root).select(F.concat_ws("/", "parent", "child").alias("path"), F.col("child").alias("title"))
    found = level
    for _ in range(depth - 1):
        level = level.join(edges, F.col("title") == F.col("parent")).select(F.concat_ws("/", "path", "child").alias("path"), F.col("child").alias("title"))
        if not level.take(1):
            break
        found = found.unionByName(level)
    return found


def optional_summaries(issues: DataFrame, summaries: DataFrame, key: str = "issue") -> DataFrame:
    """Issues with their summary, or an empty one (SRC14)."""
    joined = issues.join(summaries.select(key, F.struct("*").alias("__s")), key, "left")
    return joined.withColumn("key_events", F.coalesce("__s.key_events", F.array().cast("array<string>"))).drop("__s")


def images(spark: SparkSession, root: str) -> DataFrame:
    """Sorted image paths of a folder tree; contents are not read (SRC26)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,jpeg}").load(root)
    return rows.select("path", "length").orderBy("path")


def reflections(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """JSON files two levels below a folder, without their ``meta``; files that can't be read are left out (SRC13)."""
    rows = spark.read.schema(f"{schema}, __bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(f"{root}/*/*.json")
    return rows.where("__bad is null").drop("__bad", "meta")


def system_prompt(spark: SparkSession, folder: str, profile: str | None = None) -> str:
    """The template of a folder with its profile file, or another profile, in place of ``{profile}`` (SRC17)."""
    read = lambda path: spark.read.text(path, wholetext=True).first()[0]
    return read(f"{folder}/template.md").replace("{profile}", read(profile or f"{folder}/profile.md"))
