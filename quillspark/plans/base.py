"""Registration of queries: a name that begins with the operator's survey id, and its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mean_in_order(value: str) -> Column:
    """Aggregate: mean of a column of a read table, added up in the order of its rows.

    Sums of doubles depend on the order; ``avg`` adds up parts as the files are
    split, and a mean that a predicate meets exactly falls on either side.
    """
    at = F.when(F.col(value).isNotNull(), F.struct("_metadata.file_path", "_metadata.row_index", F.col(value).alias("v")))
    added = F.aggregate(F.array_sort(F.collect_list(at)), F.lit(0.0), lambda s, x: s + x["v"])
    return F.try_divide(added, F.count(value))
