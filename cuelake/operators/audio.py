"""Samples in chunks: PCM, channels, cutting to periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import points_in


def pcm_to_float(samples: Column, kind: str) -> Column:
    """Samples of a declared type as doubles in [-1, 1); 8-bit ones are shifted by -128 first, as if unsigned, which gives [-2, 0) for the signed type."""
    if kind in ("float", "double"):
        return samples.cast("array<double>")
    if kind not in ("tinyint", "smallint", "int"):
        raise TypeError(f"no PCM samples: {kind}")
    shift, scale = (128, 128.0) if kind == "tinyint" else (0, 32768.0 if kind == "smallint" else 2147483648.0)
    return F.transform(samples, lambda x: (x.cast("double") - shift) / scale)


def first_channel(frames: Column) -> Column:
    return F.transform(frames, lambda f: f[0])


#: Samples of the shortest blocks in which chunks and periods meet.
BLOCK = 4096


def cut_samples(chunks: DataFrame, periods: DataFrame) -> DataFrame:
    """media_id, seg_idx, chunk_idx, first_sample, samples: the parts of chunks inside periods (start_sample to end_sample).

    One row a chunk and period; a medium's samples are never gathered.  They
    meet where a chunk starts in a period, or a period inside a chunk; either way
    by a few blocks of time, however long chunk and period are.
    """
    end = F.col("start_sample") + F.size("samples")
    whole = chunks.where("size(samples) > 0").withColumn("stop_sample", end).withColumn("after_", F.col("start_sample") + 1)
    asked = periods.select("media_id", "seg_idx", F.col("start_sample").alias("p_start"), F.col("end_sample").alias("p_end")).where("p_start < p_end")
    starts = points_in(whole, asked, "media_id", "start_sample", "p_start", "p_end", BLOCK)
    met = starts.unionByName(points_in(asked, whole, "media_id", "p_start", "after_", "stop_sample", BLOCK))
    skip = F.greatest(F.col("p_start") - F.col("start_sample"), F.lit(0)).cast("int")
    stop = F.least(F.col("p_end") - F.col("start_sample"), F.size("samples")).cast("int")
    return met.select("media_id", "seg_idx", "chunk_idx", (F.col("start_sample") + skip).alias("first_sample"), F.slice("samples", skip + 1, F.greatest(stop - skip, F.lit(0))).alias("samples"))
