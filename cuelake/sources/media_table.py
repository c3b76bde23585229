"""Transcripts as a table bucketed by medium, in which media are replaced when they are recognised again.

Rows lie in BUCKETS buckets by media_id, sorted by it, and neighbouring buckets
share a partition (a shard).  What groups, sorts or joins by media_id reads the
table without an exchange.  Replacing media rewrites the shards that they lie in
and no others, as a dynamic partition overwrite: new files are written beside
the old ones and take their place when all tasks have ended, shard by shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
SHARDS = 16


def _shard(buckets: int, shards: int) -> Column:
    # Spark's own bucket of a medium is pmod(hash(media_id), buckets).
    return F.call_function("div", F.pmod(F.hash("media_id"), F.lit(buckets)) * shards, F.lit(buckets)).cast("int")


def _placed(rows: DataFrame, buckets: int, shards: int) -> DataFrame:
    """Rows with their shard, one task a bucket, so that a bucket of a shard is one file."""
    return rows.withColumn("shard", _shard(buckets, shards)).repartition(buckets, "media_id")


def create_table(rows: DataFrame, name: str, path: str, order: list[str], buckets: int = BUCKETS, shards: int = SHARDS) -> DataFrame:
    """Stores ``rows``, which have a media_id, as table ``name`` in ``path``, each medium sorted by ``order``.

    A null media_id is a medium of its own; no rows make an empty table; a
    column named shard is an error.
    """
    if "shard" in rows.columns:
        raise ValueError("shard is a column of the table itself")
    if buckets % shards:
        raise ValueError(f"{buckets} buckets can't be dealt to {shards} shards")
    writer = _placed(rows, buckets, shards).write.format("parquet").partitionBy("shard").bucketBy(buckets, "media_id").sortBy("media_id", *order)
    writer.option("path", path).option("partitionOverwriteMode", "dynamic").option("shards", str(shards)).saveAsTable(name)
    return stored(rows.sparkSession, name)


def stored(spark: SparkSession, name: str) -> DataFrame:
    """The table's rows without the shard."""
    return spark.table(name).drop("shard")


def replace_media(rows: DataFrame, name: str) -> DataFrame:
    """All rows of the media in ``rows`` give way to them; other media keep theirs, and other shards their files.

    ``rows`` is read three times, so it should be a stored table.
    """
    spark = rows.sparkSession
    buckets, shards = _layout(spark, name)
    # At most as many numbers as there are shards.
    touched = [r.shard for r in rows.select(_shard(buckets, shards).alias("shard")).distinct().collect()]
    if touched:
        media = rows.select(F.col("media_id").alias("new_id")).distinct()
        kept = spark.table(name).where(F.col("shard").isin(touched)).drop("shard")
        kept = kept.join(media, F.col("media_id").eqNullSafe(F.col("new_id")), "left_anti")
        columns = spark.table(name).columns
        _placed(kept.unionByName(rows.select(kept.columns)), buckets, shards).select(columns).write.insertInto(name, overwrite=True)
        spark.catalog.refreshTable(name)
    return stored(spark, name)


def _layout(spark: SparkSession, name: str) -> tuple[int, int]:
    """Numbers of buckets and shards that the table was made with."""
    facts = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    options = dict(x.split("=", 1) for x in facts["Storage Properties"].strip("[]").split(", "))
    return int(facts["Num Buckets"]), int(options["shards"])
