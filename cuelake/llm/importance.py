"""Target-distribution importance resampling: documents drawn by how much they read like a target.

Words (runs of letters, digits and non-ASCII characters, A-Z lower-cased) and
runs of up to ``n`` words are hashed into BUCKETS places.  A place's gain is the log
ratio of its smoothed share in the target and in the corpus; a document's weight is
the sum of its features' gains, and its score the weight and Gumbel noise
of its own id, so that the highest scores are a draw without replacement.

Scores come from arrays: a task counts places in one array, and scores look the
gains up in another, a text at a time being a run of one array of a batch.  The
cutoff is found without sorting: scores are whole numbers, so the range between
the least and the greatest is halved by counting the rows above its middle, job
by job over the stored scores, and ties at the cutoff are halved by doc_id in
the same way.  A job counts at several thresholds at once, which is several
halvings.  Only what is drawn is range-partitioned, and ranks follow from the
partitions' sizes.

Defined cases: null and empty texts have no features, weight 0 and are not
drawn; without target texts all gains follow from the corpus alone.  A null id
draws the noise of an empty id and comes after all ids.  Rows that repeat an id
are drawn each; equal rows get neighbouring ranks.  Very long texts and words
count whole.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblock as tb
from .common import Scratch

BUCKETS = 10_000
N_GRAM = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Thresholds that one job counts at.
FAN = 63

_WORD = np.ones(256, bool)
_WORD[:0x30] = _WORD[0x3A:0x61] = _WORD[0x7B:0x80] = False
#: Words longer than this are hashed one by one, not byte by byte with all others.
_LONG = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _extend(crc: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of what ``crc`` stands for followed by ``text[start:end]``, for all spans at once."""
    crc, size = crc ^ np.uint32(0xFFFFFFFF), end - start
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -_LONG) :]
    live, at = order, 0
    lengths = -size[order]
    while len(live):
        live = order[: np.searchsorted(lengths, -at)]
        crc[live] = _CRC[(crc[live] ^ text[start[live] + at]) & 0xFF] ^ (crc[live] >> np.uint32(8))
        at += 1
    crc ^= np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > _LONG):
        crc[k] = zlib.crc32(text[start[k] : end[k]].tobytes(), int(crc[k]))
    return crc


def _features(raw: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of a block of texts, and the number of words of each row."""
    text, rows = tb._LOWER[raw], len(off) - 1
    inside = np.zeros(len(text) + 2, bool)
    inside[1:-1] = _WORD[text]
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(text))]  # a word never spans two texts
    starts[edge], ends[edge - 1] = _WORD[text[edge]], _WORD[text[edge - 1]]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(rows), np.diff(first))
    crc = _extend(np.zeros(len(start), np.uint32), text, start, end)
    row, code = [doc], [crc % np.uint32(BUCKETS)]
    space = np.frombuffer(b" ", np.uint8)
    for k in range(1, n):
        crc, head = crc[:-1] if len(crc) else crc, doc[: max(len(doc) - k, 0)]
        crc = _extend(crc, space, np.zeros(len(crc), np.int64), np.ones(len(crc), np.int64))
        crc = _extend(crc, text, start[k:], end[k:])
        whole = head == doc[k:]
        row, code = [*row, head[whole]], [*code, crc[whole] % np.uint32(BUCKETS)]
    return np.concatenate(row), np.concatenate(code).astype(np.int64), np.diff(first)


def bucket_counts(docs: DataFrame, n: int = N_GRAM) -> DataFrame:
    """bucket, n: features of all texts in each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, raw, off in tb.blocks(batch.column(0)):
                total += np.bincount(_features(raw, off, n)[1], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(spark: SparkSession, docs: DataFrame, target: DataFrame, n: int = N_GRAM) -> np.ndarray:
    """The gain of each bucket, in thousandths: BUCKETS whole numbers."""
    s, t = bucket_counts(docs, n).withColumnRenamed("n", "s"), bucket_counts(target, n).withColumnRenamed("n", "t")
    both = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    gain = F.floor(1000 * F.log((d("t") + 1) * (d("all_s") + BUCKETS) / ((d("s") + 1) * (d("all_t") + BUCKETS))))
    rows = both.crossJoin(F.broadcast(total)).select("bucket", gain.cast("long").alias("gain")).orderBy("bucket").toPandas()  # BUCKETS rows, whatever the input
    return rows["gain"].to_numpy(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, in thousandths."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    share = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share))).cast("long")


def score(spark: SparkSession, docs: DataFrame, gain: np.ndarray, n: int = N_GRAM, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row of ``docs``."""
    shared = spark.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = [[np.zeros(0, np.int64)] for _ in range(3)]
            for first, end, raw, off in tb.blocks(batch.column(1)):
                row, code, words = _features(raw, off, n)
                weight = np.bincount(row, own[code], end - first)  # whole numbers far below 2^53
                for k, part in enumerate((words, np.bincount(row, minlength=end - first), weight)):
                    out[k].append(part.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x)) for x in out)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    return scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _halve(rows: DataFrame, value: Column, low: int, high: int, wanted: int) -> int:
    """The least x in [low, high] of which at most ``wanted`` rows have a value above x: exact counts, job after job."""
    while low < high:
        width = high - low
        points = sorted({low + width * k // (FAN + 1) for k in range(FAN + 1)})
        above = rows.agg(*(F.count(F.when(value > p, 1)).alias(f"c{k}") for k, p in enumerate(points))).first()
        fits = [p for k, p in enumerate(points) if above[k] <= wanted]
        high = fits[0] if fits else high
        low = max([low, *(p + 1 for k, p in enumerate(points) if above[k] > wanted)])
    return low


def cutoff(scored: DataFrame, wanted: int) -> tuple[int, int]:
    """(score, doc_id): rows above the score are drawn, and at the score those with an id up to this one; null ids come last."""
    ends = scored.agg(F.min("score"), F.max("score")).first()
    # Of the scores that at most ``wanted`` rows exceed, the least: it is the last row's.
    at = _halve(scored, F.col("score"), ends[0] - 1, ends[1], wanted)
    rest = wanted - scored.where(F.col("score") > at).count()
    if rest <= 0:
        return at, -(1 << 63)
    # Among ties the bits of the id are turned over, so that smaller ids lie above.
    turned = F.bitwise_not(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("turned")
    tied = scored.where(F.col("score") == at).select(turned)
    ends = tied.agg(F.min("turned"), F.max("turned")).first()
    return at, ~_halve(tied, F.col("turned"), ends[0], ends[1], rest - 1)


def draw(spark: SparkSession, scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``scored`` with ``rank``, from 1 in order of score and doc_id; null where a row is not drawn."""
    scratch = Scratch(spark, "importance")
    scored = scratch.store(scored, "scored")
    open_ = scored.where(F.col("n_words") >= min_words)
    wanted = percent * open_.count() // 100
    none = F.lit(None).cast("long")
    if wanted == 0:
        return scored.withColumn("rank", none)
    at, last = cutoff(open_.select("doc_id", "score"), wanted)
    ids = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    drawn = (F.col("n_words") >= min_words) & ((F.col("score") > at) | ((F.col("score") == at) & (ids <= last)))
    order = [F.col("score").desc(), ids.asc(), F.col("n_features").asc(), F.col("weight").asc(), F.col("tie_").asc()]
    ranged = scored.where(drawn).withColumn("tie_", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    # The number of a row is its partition, in the upper bits, and its place there.
    ranged = scratch.store(ranged.withColumn("place_", F.monotonically_increasing_id()), "ranged")
    part, own = F.shiftright("place_", 33), F.col("place_").bitwiseAND((1 << 33) - 1)
    sizes = {r.part: r.n for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, starts = 0, []
    for k in sorted(sizes):
        starts.append((k, before))
        before += sizes[k]
    starts = spark.createDataFrame(starts, "part_ long, before_ long")
    ranked = ranged.join(F.broadcast(starts), part == F.col("part_")).withColumn("rank", F.col("before_") + own + 1)
    # Equal rows at the cutoff may be more than are wanted.
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return scored.where(~drawn).withColumn("rank", none).unionByName(ranked.select(*scored.columns, "rank"))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, n: int = N_GRAM, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of ``docs`` against the texts of ``target``."""
    found = draw(spark, score(spark, docs, gains(spark, docs, target, n), n, seed), percent, min_words)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH poly AS (
  SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM range(256) AS r(i)
  )
), corpus AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), target AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), s AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM corpus) GROUP BY word
), t AS (
  SELECT word, count(*) AS n FROM target GROUP BY word
), bytes AS (
  SELECT word, list_transform(range(len(h) // 2), lambda i: instr('0123456789ABCDEF', h[2 * i + 1]) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 17) AS b
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM s UNION SELECT word FROM t))
), coded AS (
  SELECT word, xor(list_reduce(b, lambda c, x: xor(c // 256, crcs[xor(c % 256, x) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, poly
), filled AS (
  SELECT bucket, CAST(sum(s.n) AS BIGINT) AS s, CAST(coalesce(sum(t.n), 0) AS BIGINT) AS t FROM coded LEFT JOIN s USING (word) LEFT JOIN t USING (word) GROUP BY bucket
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * ((SELECT sum(s) FROM filled) + 10000) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * ((SELECT sum(t) FROM filled) + 10000)))) AS BIGINT) AS gain FROM filled
), valued AS (
  SELECT word, gain FROM coded JOIN gain USING (bucket)
), weighed AS (
  SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM (SELECT doc_id, unnest(w) AS word FROM corpus) JOIN valued USING (word) GROUP BY doc_id
), scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM corpus LEFT JOIN weighed USING (doc_id)
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN CAST(rank AS BIGINT) END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
