"""Accepted and rejected rows by one pass over a table, with their counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Audit:
    """``accepted``: the rows as given; ``rejects``: (table, key, reason); the counts are those of the pass itself."""

    accepted: DataFrame
    rejects: DataFrame
    n_accepted: int
    n_rejected: int


def split_rows(rows: DataFrame, reason: Column, keys: list[str], table: str, path: str) -> Audit:
    """Writes ``rows`` to ``path`` once, those with a ``reason`` apart from the others, and reads either part from there.

    The source is read once whatever is asked of the two parts, and either is
    a folder that a scan is pruned to.  A null reason accepts a row.  ``key`` is
    the ``keys`` in JSON, nulls left out.  Columns named reject_ or status_ are an error; no rows
    give two empty tables.
    """
    if {"reject_", "status_"} & set(rows.columns):
        raise ValueError("reject_ and status_ are columns of the written table itself")
    seen = Observation(f"rows of {table}")
    marked = rows.withColumn("reject_", reason.cast("string"))
    marked = marked.withColumn("status_", F.when(F.col("reject_").isNull(), "accepted").otherwise("rejected"))
    counted = marked.observe(seen, F.count_if(F.col("reject_").isNull()).alias("accepted"), F.count_if(F.col("reject_").isNotNull()).alias("rejected"))
    counted.write.partitionBy("status_").parquet(path)
    back = rows.sparkSession.read.schema(marked.schema).parquet(path)
    part = lambda status: back.where(F.col("status_") == status)
    key = F.to_json(F.struct(*keys)).alias("key")
    rejects = part("rejected").select(F.lit(table).alias("table"), key, F.col("reject_").alias("reason"))
    return Audit(part("accepted").select(rows.columns), rejects, seen.get["accepted"], seen.get["rejected"])
