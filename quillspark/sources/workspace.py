"""Paths for written data: the cluster's shared folder, or an own one where that is unset and all is one process."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []


def fresh(spark: SparkSession, label: str) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not shared:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='quillspark-')}")
        shared = _OWN[0]
    return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
