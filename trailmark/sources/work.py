"""Folders for tables that a query writes and reads again."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, spark.checkpoint.dir, or, where Spark runs in one
    process and none is set, in a temporary one. Removed when the driver ends."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="trailmark-")
    path = f"{top.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_clean)
    _MADE.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _MADE:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return
