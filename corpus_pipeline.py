"""A corpus pipeline: quality, language, near copies, benchmark leaks, packing.

Defined results.  Null and empty texts: the scorer's prior decides in the first
stage, and the second drops them, as no language is told.  Rows without a
doc_id link with nothing in the third stage and go on; of repeated rows one
stays, and of one id with different texts each goes by its own text.  Very long
texts are read whole in every stage.  Ties: of near copies the least doc_id
stays, then the least hash of the text.  An empty table of documents gives no
rows, an empty benchmark leaves all documents clean.  Documents may have more
columns, of any names; all stages but the last return them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, language, ngram_join, packing, quality, scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return language.keep_identified(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity of 0.8 or more."""
    return ngram_join.keep_one(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("language identification", keep_language),
    ("n-gram Jaccard join", keep_distinct),
    ("benchmark decontamination", keep_clean),
    ("best-fit packing", pack),
]

#: No stage but the fourth could be told in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
