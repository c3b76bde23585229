"""Data checks of transcripts: what the other operators take for granted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _faults() -> dict[str, Column]:
    """The faults that a sentence shows by itself: reason -> whether it has it."""
    falls = F.transform("timestamp", lambda t, i: t.end_ms < F.greatest(t.start_ms, F.try_element_at("timestamp", F.when(i > 0, i)).end_ms))
    falls = F.exists(falls, lambda x: F.coalesce(x, F.lit(False)))
    number = F.coalesce(F.size("tokens") != F.size("timestamp"), F.lit(True))
    empty = F.coalesce(F.size("timestamp") <= 0, F.lit(True))
    return {"tokens and times differ in number": number, "no token": empty, "token times fall": ~empty & falls}


def row_fault() -> Column:
    """The first fault that a sentence shows by itself, null where it has none."""
    return F.coalesce(*(F.when(has, reason) for reason, has in _faults().items()))


def transcript_faults(sentences: DataFrame) -> DataFrame:
    """media_id, sent_idx, reason: a row for each fault of a sentence (media_id, sent_idx, tokens, timestamp).

    Faults: tokens and times of different number, no tokens, a token that ends
    before it starts or before the one ahead of it, and a sentence that starts
    before the one ahead of it.  A sentence is compared with its neighbour
    only, so a medium is not gathered, but sorted by ``sent_idx``; only what was
    found in the arrays goes through the sort, not the arrays.
    """
    own = F.array_compact(F.array(*(F.when(has, reason) for reason, has in _faults().items())))
    rows = sentences.select("media_id", "sent_idx", own.alias("own"), F.try_element_at("timestamp", F.lit(1)).start_ms.alias("start"))
    rows = rows.withColumn("before", F.lag("start").over(Window.partitionBy("media_id").orderBy("sent_idx")))
    reasons = F.concat("own", F.array_compact(F.array(F.when(F.col("start") < F.col("before"), "starts before the sentence ahead"))))
    return rows.select("media_id", "sent_idx", F.explode(reasons).alias("reason"))


def sound(sentences: DataFrame) -> DataFrame:
    """The sentences without a fault."""
    return sentences.join(transcript_faults(sentences).select("media_id", "sent_idx").distinct(), ["media_id", "sent_idx"], "left_anti")
