"""Shared scratch space: lineage is cut by tables written where every executor can read them.

The folder is the cluster's ``spark.checkpoint.dir``; only where that is unset
and driver and executors are one process (``local[n]``, as in tests) a local
folder is made.  On a cluster without the setting operators raise.  Files are written through Spark or, for binary
outputs, through a pyarrow file system opened from the folder's URI.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def root(spark: SparkSession) -> str:
    """URI of the session's shared folder."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not shared:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='quillspark-')}")
        shared = _OWN[0]
    return f"{shared.rstrip('/')}/quillspark-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return a scan of it.

    The scan survives lost executors, and its file sizes let the planner choose
    a broadcast join only where the table is really small.
    """
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def _delete(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete staged tables that later stages no longer read, and let go of the shuffle files of finished stages.

    Spark deletes shuffle files once the driver's garbage collector finds their
    plans unreachable, which a driver that does little else may not do for long.
    """
    for table in tables:
        _delete(spark, table.scratch_path)
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = 500):
    """Lets the Arrow batches of what is run inside hold no more than ``rows`` rows: texts are long, and a batch is held several times over in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def clear(spark: SparkSession) -> None:
    """Remove everything that this session wrote to the shared folder."""
    _delete(spark, root(spark))
