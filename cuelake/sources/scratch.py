"""Where tables that a query writes go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def base_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, where every executor and the driver can read and write.

    Where it is unset, a session on one machine gets a temporary folder; on a cluster that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-cuelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def folder(spark: SparkSession, label: str) -> str:
    """A new folder in the cluster's shared storage."""
    return f"{base_folder(spark)}/{label}-{uuid.uuid4().hex}"
