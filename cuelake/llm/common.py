"""Shared helpers: scratch tables in the cluster's shared folder, word counts."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import folder

#: Words everywhere in this subpackage: runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables of one run in the folder that the cluster names in spark.checkpoint.dir.

    A stored table cuts the lineage like a checkpoint, is written once, and is
    still there when an executor is lost.  Tables that only led to a later one
    are dropped once that is stored.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = folder(spark, f"cuelake-{label}")
        self.paths: list[str] = []

    def path(self, name: str) -> str:
        self.paths.append(f"{self.root}/{len(self.paths) + 1:03d}-{name}")
        return self.paths[-1]

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the written table."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def store_by(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """Like ``store``, in one file for each bucket of ``key``: joins on it read the table without an exchange."""
        table, buckets = f"cuelake_{name}_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", self.path(name)).saveAsTable(table)
        stored = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")  # the name only; the files are not the catalogue's
        return stored

    def mark(self) -> int:
        return len(self.paths)

    def drop(self, mark: int) -> None:
        """Delete what was stored since ``mark``, but for the last table."""
        self._delete(self.paths[mark:-1])

    def release(self, *names: str) -> None:
        """Delete the tables of these names, and let go of shuffle files that no plan refers to any more.

        Spark deletes shuffle files when the driver collects its garbage, by
        itself every half hour; jobs of a run leave theirs behind much faster.
        The last job's go with a second collection only.
        """
        self._delete([p for p in self.paths if p.rpartition("/")[2].partition("-")[2] in names])
        self.spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, paths: list[str]) -> None:
        context = self.spark.sparkContext
        for name in paths:
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty.

    Counts the places where a word begins, on the text reduced to one byte a
    word, so that no array of all words is built.
    """
    shrunk = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.regexp_replace(shrunk, r"[^w]+", "")).cast("long")
