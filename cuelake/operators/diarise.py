"""Speakers of sentences from a diarisation that has cuts of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import points_in
from .match import envelopes

#: Milliseconds of a base block, about a short sentence.
BLOCK_MS = 2048


def overlaps(sentences: DataFrame, turns: DataFrame) -> DataFrame:
    """media_id, sent_idx, spk, overlap_ms: a row for each sentence and turn of a medium that share time.

    Two periods share time if one starts in the other: two equi joins by
    blocks of time, each pair in one of them, and no medium in one task.
    """
    own = envelopes(sentences).select("media_id", "sent_idx", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    said = envelopes(turns).where("spk is not null").select("media_id", "spk", F.col("start_ms").alias("c"), F.col("end_ms").alias("d"))
    later = points_in(said, own, "media_id", "c", "a", "b", BLOCK_MS)
    earlier = points_in(own, said, "media_id", "a", "c", "d", BLOCK_MS).where("a > c")
    both = later.select("media_id", "sent_idx", "spk", "a", "b", "c", "d").unionByName(earlier.select("media_id", "sent_idx", "spk", "a", "b", "c", "d"))
    return both.select("media_id", "sent_idx", "spk", (F.least("b", "d") - F.greatest("a", "c")).alias("overlap_ms")).where("overlap_ms > 0")


def with_speakers(sentences: DataFrame, turns: DataFrame) -> DataFrame:
    """Sentences with ``spk`` and ``overlap_ms``: who speaks for most of a sentence's time, of several the smallest number.

    A sentence that shares no time with a turn, or has no length, has a null speaker and 0.
    """
    each = overlaps(sentences, turns).groupBy("media_id", "sent_idx", "spk").agg(F.sum("overlap_ms").alias("ms"))
    most = each.groupBy("media_id", "sent_idx").agg(F.max(F.struct("ms", (-F.col("spk")).alias("order"))).alias("m"))
    most = most.select("media_id", "sent_idx", (-F.col("m.order")).alias("spk"), F.col("m.ms").alias("ms"))
    return sentences.drop("spk").join(most, ["media_id", "sent_idx"], "left").withColumn("overlap_ms", F.coalesce("ms", F.lit(0))).drop("ms")
