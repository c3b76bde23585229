"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text are its distinct words, pairs of neighbours and pairs with
one word between (A-Z lower-cased, ASCII punctuation separates), hashed into
2^BITS places.  FTRL-proximal learns with a rate of its own for each place
and an L1 penalty that leaves most weights at exactly zero, so that the model
is a short list that is broadcast for scoring.

Labels are learned only from rows outside the held-out quarter (crc32 of the
id as text, modulo 4, is 2), from at most MAX_ROWS of them, the first by a
hash of the id; the bound is a parameter.  The sample is dealt to SHARDS tasks
that learn independently; their weights are averaged.  Scores use the text
alone, and the whole of it, in one pass without a shuffle.

Defined cases: null and empty texts have no features and get the intercept's
score; rows that repeat an id are scored each and train once; contradicting
labels count as their largest; without labels the score is 0.  A null id is
held out like the text "null".  An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblock as tb
from .common import Scratch

BITS = 20
MAX_ROWS = 20_000
SHARDS = 2
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.0
THRESHOLD = 0.3
_KEEP = ~tb._SPACE & ~np.isin(np.arange(256), [i for i in range(33, 127) if not chr(i).isalnum()])


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(4)) == 2


def _places(raw: np.ndarray, off: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place) of the features of each text; with ``wanted``, a truth value a place, of those only."""
    words = tb.Words(raw, off, keep=_KEEP)
    row, code = [words.doc], [words.hash]
    for gap in (1, 2):
        first = np.arange(max(len(words.hash) - gap, 0))
        first = first[words.doc[first] == words.doc[first + gap]]
        row.append(words.doc[first])
        code.append(tb.mix64(words.hash[first] * tb._Q + words.hash[first + gap] + np.uint64(gap)))
    row, place = np.concatenate(row).astype(np.int64), (np.concatenate(code) >> np.uint64(64 - BITS)).astype(np.int64)
    if wanted is not None:
        use = wanted[place]
        row, place = row[use], place[use]
    key = tb.sorted_distinct(row << BITS | place)
    return key >> BITS, key & ((1 << BITS) - 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, raw, off in tb.blocks(batch.column(1)):
            row, place = _places(raw, off)
            starts = np.searchsorted(row, np.arange(end - first + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first), pa.ListArray.from_arrays(pa.array(starts), pa.array(place.astype(np.int32)))], ["doc_id", "label", "places"]
            )


def learn(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal: the places with a weight and their weights; place 2^BITS is the intercept."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    rows = [np.append(r, 1 << BITS) for r in rows]

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= L1, 0.0, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for epoch in range(epochs):
        for k in np.argsort(tb.mix64(np.arange(len(rows), dtype=np.uint64) + np.uint64(epoch * 1_000_003))):
            at = rows[k]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    every = np.arange(len(z))
    w = weights(every)
    return every[w != 0], w[w != 0]


def _learn_shard(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("doc_id")
    place, weight = learn([np.asarray(x, np.int64) for x in frame["places"]], frame["label"].to_numpy(float))
    return pd.DataFrame({"place": place, "weight": weight})


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    scratch = Scratch(spark, "toxicity")
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    marks = marks.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id", F.lit("toxic")), "doc_id").limit(max_rows)
    marks = scratch.store(marks, "chosen")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most max_rows ids.
    sample = rows.join(F.broadcast(marks), "doc_id").dropDuplicates(["doc_id"]).mapInArrow(_features, "doc_id long, label int, places array<int>")
    sample = scratch.store(sample.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS))), "sample")
    learned = sample.groupBy("shard").applyInPandas(lambda pdf: _learn_shard(pdf), "place long, weight double")
    shards = max(1, sample.select("shard").distinct().count())
    # At most 2^BITS + 1 rows, in practice a few thousand.
    mean = learned.groupBy("place").agg((F.sum("weight") / shards).alias("weight")).toPandas().sort_values("place")
    return mean["place"].to_numpy(np.int64), mean["weight"].to_numpy(float)


def score(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << BITS) + 1)
        place, weight = shared.value
        table[place] = weight
        for batch in batches:
            parts = [np.zeros(0)]
            for first, end, raw, off in tb.blocks(batch.column(1)):
                row, at = _places(raw, off, table != 0)  # places without a weight add nothing
                margin = np.bincount(row, table[at], end - first) + table[-1]
                parts.append(1 / (1 + np.exp(-np.clip(margin, -35, 35))) if len(place) else np.zeros(end - first))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
