"""A folder that driver and executors share, for what a job writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set; intermediate tables need a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")  # one process: there is nobody to share with
        context.setCheckpointDir(found)
    return f"{found.rstrip('/')}/corpusloom-{name}-{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder; nothing, if the application has ended before."""
    if spark.sparkContext._jsc is None:
        return
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except (Py4JError, OSError):  # the other side has gone
        pass
