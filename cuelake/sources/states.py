"""What a recogniser leaves of each medium, as files: its sentences, and the list of a diarisation where there was one.

A folder holds JSON lines, one a sentence, under ``list=sentences`` and
``list=sd_sentences``, the two lists of a medium, whose cuts may differ.  A
record has media_id, sent_idx, text, tokens, timestamp (a [start, end] in
milliseconds for each token) and, in the second list, spk.

Reading never stops at a record: one that is no JSON, lacks what it needs or
has a wrong type goes to a table of rejects with the reason.  A folder without the second
list gives an empty one.  Other fields of a record are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The names of the two lists.
SENTENCES, DIARISED = "sentences", "sd_sentences"
_RECORD = "media_id long, sent_idx int, text string, tokens array<string>, timestamp array<array<long>>, spk int, broken_ string"


class State(NamedTuple):
    """sentences and diarised: media_id, sent_idx, spk, text, tokens, timestamp; rejects: list, media_id, sent_idx, reason, record."""

    sentences: DataFrame
    diarised: DataFrame
    rejects: DataFrame


def state_lines(sentences: DataFrame, diarised: DataFrame | None = None) -> DataFrame:
    """list, media_id, sent_idx, value: the records of one or both lists as JSON."""
    def lines(table: DataFrame, kind: str) -> DataFrame:
        pairs = F.transform("timestamp", lambda t: F.array(t.start_ms, t.end_ms))
        spk = [F.col("spk")] if kind == DIARISED else []
        record = F.to_json(F.struct("media_id", "sent_idx", "text", "tokens", pairs.alias("timestamp"), *spk))
        return table.select(F.lit(kind).alias("list"), "media_id", "sent_idx", record.alias("value"))

    own = lines(sentences, SENTENCES)
    return own if diarised is None else own.unionByName(lines(diarised, DIARISED))


def write_state(lines: DataFrame, path: str) -> None:
    """The records of ``state_lines`` in files, a folder for each list."""
    lines.select("list", "value").write.partitionBy("list").text(path)


def _reason() -> Column:
    pair = lambda t: (F.size(t) == 2) & F.get(t, 0).isNotNull() & F.get(t, 1).isNotNull()
    reasons = {
        "not readable": F.col("broken_").isNotNull(),
        "no medium or number": F.col("media_id").isNull() | F.col("sent_idx").isNull(),
        "no token": F.coalesce(F.size("tokens") <= 0, F.lit(True)) | F.col("tokens").isNull(),
        "tokens and times differ in number": F.col("timestamp").isNull() | (F.size("tokens") != F.size("timestamp")) | ~F.forall("timestamp", lambda t: F.coalesce(pair(t), F.lit(False))),
        "no speaker": (F.col("list") == DIARISED) & F.col("spk").isNull(),
    }
    return F.coalesce(*(F.when(bad, reason) for reason, bad in reasons.items()))


def read_state(spark: SparkSession, path: str) -> State:
    """The two lists of all media under ``path``, and what could not be read of them."""
    reader = spark.read.schema(_RECORD + ", list string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken_")
    rows = reader.json(path).withColumn("reason", _reason())
    times = F.transform("timestamp", lambda t: F.struct(F.get(t, 0).alias("start_ms"), F.get(t, 1).alias("end_ms")))

    def one(kind: str) -> DataFrame:
        return rows.where((F.col("list") == kind) & F.col("reason").isNull()).select("media_id", "sent_idx", "spk", "text", "tokens", times.alias("timestamp"))

    # Of a record that is no JSON its first fields may have been read; they are not to be trusted.
    known = lambda c: F.when(F.col("broken_").isNull(), F.col(c)).alias(c)
    rejects = rows.where("reason is not null").select("list", known("media_id"), known("sent_idx"), "reason", F.col("broken_").alias("record"))
    return State(one(SENTENCES), one(DIARISED), rejects)
