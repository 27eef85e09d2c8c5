"""Record sinks: overwrite, append, fan-out, partitioned, versioned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines (SNK01, SNK02, SNK17)."""
    df.write.mode("append" if append else "overwrite").json(path)


def by_value(df: DataFrame, path: str, key: str, append: bool = False) -> None:
    """A folder for each value of a key (SNK04, SNK05)."""
    df.write.mode("append" if append else "overwrite").partitionBy(key).json(path)


def fan_out(df: DataFrame, everything: str, passing: str, ok: str) -> None:
    """All rows to one sink, the passing to another; the rows are computed once (SNK03)."""
    df.write.mode("append").parquet(everything)
    df.sparkSession.read.schema(df.schema).parquet(everything).where(ok).write.mode("append").parquet(passing)


def csv_json(df: DataFrame, path: str) -> None:
    """CSV with all cells quoted; nested ones as JSON; blanks at the ends of cells stay (SNK06, SNK07)."""
    cells = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*cells).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def version(df: DataFrame, path: str, number: int, keep: int = 3) -> None:
    """A numbered version; readers see the last ``keep`` (SNK10)."""
    df.withColumn("version", F.lit(number)).write.mode("append").partitionBy("version").parquet(path)
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for old in range(max(0, number - keep + 1)):
        gone = fs_path(f"{path}/version={old}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version (SNK10)."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("version") == rows.agg(F.max("version")).first()[0])


def rollback(log: DataFrame, step: str, upto: int) -> DataFrame:
    """Log rows up to a step (SNK12)."""
    return log.where(F.col(step) <= upto)


def resume(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs that no completed id covers (JON01-JON04, JON12, STM01)."""
    return inputs.join(done.select(*keys).distinct(), keys, "left_anti")


def run_resumable(inputs: DataFrame, path: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> int:
    """Process what is pending and append its results; rows that fail are left out and stay pending (STM02). Returns rows written."""
    spark = inputs.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    before = spark.read.parquet(path).count() if there else 0
    pending = resume(inputs, spark.read.parquet(path), keys) if there else inputs
    work(pending).write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def relayout(path, pattern: str, to: str):
    """Paths rewritten by a pattern (SNK18)."""
    return F.regexp_replace(path, pattern, to)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made only if it has not been finished before (STM09)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
