"""Work tables of the queries, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir, which goes when the driver's JVM ends.

    Where the setting is unset, a local master, as in tests, gets a folder of this process; any other is refused, because its
    executors could not see such a folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = Path(tempfile.mkdtemp(prefix="paraforge-")).as_uri()
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/paraforge-{uuid.uuid4().hex[:12]}")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(root)
    fs.deleteOnExit(root)
    return f"{root.toString()}/{name}"
