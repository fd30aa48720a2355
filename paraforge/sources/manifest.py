"""Manifests of a table's files with their digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidFileError


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) for each data file under a path, worked out where the files are read. A file is held as a whole by its task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def check_manifest(spark: SparkSession, path: str, manifest: DataFrame) -> None:
    """InvalidFileError names a file that is missing, new or other than the manifest says."""
    now = file_manifest(spark, path).select("file", F.struct("bytes", "sha256").alias("now"))
    both = manifest.select("file", F.struct("bytes", "sha256").alias("then")).join(now, "file", "full_outer")
    bad = both.where(~F.col("then").eqNullSafe(F.col("now"))).select("file").limit(1).collect()
    if bad:
        raise InvalidFileError(f"{bad[0][0]} is not as the manifest says")
