"""Media files in a folder: what a scan of names and sizes tells of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prompts import with_modality

LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: Tasks for each core that list the folders.
FOLDER_TASKS = 4


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """media_id, path, n_bytes, modality, reason of all files under ``path``, at any depth, whose names match ``glob``.

    ``path`` is relative to the folder and media_id its hash.  The files are
    listed, not read: their content is no column of the scan.  Files of other kinds are kept with a reason, as in
    the manifest.  Files and folders whose names begin with "_" or "." and empty files are
    left out, as in all of Spark's scans.
    """
    # Listed a few folders a task: by itself Spark starts a task for each of up to 10,000 folders.
    was = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(was), FOLDER_TASKS * spark.sparkContext.defaultParallelism)))
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length")
    finally:
        spark.conf.set(LISTING, was)
    root = (path.partition("://")[2] or path.removeprefix("file:")).rstrip("/")
    full = F.col("path")
    name = F.substring(full, F.locate(root, full) + len(root) + 1, F.length(full))
    return with_modality(files.select(F.xxhash64(name).alias("media_id"), name.alias("path"), F.col("length").alias("n_bytes")))
