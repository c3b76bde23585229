"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items and texts are words as everywhere here, A-Z lower-cased, compared
without ASCII punctuation at their ends.  Seeds are the 3-word runs of the
items, however often they occur; an item of fewer words is one seed.  Texts that share a seed with an item are
candidates; each stretch of text around its seeds that has enough of the
item's words to reach MIN_SCORE is aligned with the item (match 2, mismatch
-1, gap -1), and so is what lies before and behind a passage found.  The score
is the best alignment divided by that of the item with itself; a text is
contaminated from MIN_SCORE on.

Seeds of the items are broadcast while they are fewer than MAX_BROADCAST;
beyond that texts' runs and seeds meet in a shuffled join.

Defined cases: null or empty texts are clean; items without words are no item;
those of one or two words are found where they stand as they are.  Rows that
repeat a doc_id count as one text each and give one row a passage; a null id is
reported as null, its texts are told apart by their hash.  Repeated items are
all reported.  A very long text is aligned around its seeds, wherever they are.
Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblock as tb
from .common import Scratch

SEED = 3
MIN_SCORE = 0.5
MAX_BROADCAST = 2_000_000
GAP, MISMATCH, MATCH = 1, 1, 2
#: Words between two seeds of one item from which on they belong to separate stretches.
APART = 3

_KEEP = ~tb._SPACE & ~np.isin(np.arange(256), [i for i in range(33, 127) if not chr(i).isalnum()])


def _words(raw: np.ndarray, off: np.ndarray) -> tb.Words:
    """Words without ASCII punctuation: punctuation separates, as space does."""
    return tb.Words(raw, off, keep=_KEEP)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, size, seed, words) per seed of an item; size: the seed's words, words: the hashes of all of the item's."""
    for batch in batches:
        for first, end, raw, off in tb.blocks(batch.column(1)):
            words = _words(raw, off)
            count = np.diff(words.first)
            parts = []
            for n in range(1, SEED + 1):
                row, _, value = words.grams(n)
                own = count[row] == n if n < SEED else np.ones(len(row), bool)
                parts.append((row[own], np.full(own.sum(), n, np.int32), value[own]))
            row, size, value = (np.concatenate(x) for x in zip(*parts, strict=True))
            ids = batch.column(0).slice(first, end - first)
            lists = [words.hash[a:b].view(np.int64).tolist() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(size), pa.array(value.view(np.int64)), pa.array([lists[i] for i in row], pa.list_(pa.int64()))], ["item_id", "size", "seed", "words"])


def _seed_hits(known: Broadcast | None, sizes: list[int]):
    """(doc_id, twin, pos, seed) of the runs of ``sizes`` words of each text, of those in ``known`` if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value if known is not None else None
        for batch in batches:
            for first, end, raw, off in tb.blocks(batch.column(2)):
                words = _words(raw, off)
                for n in sizes:
                    row, at, value = words.grams(n)
                    value = value.view(np.int64)
                    if table is not None:
                        spot = np.minimum(np.searchsorted(table, value), len(table) - 1)
                        hit = table[spot] == value
                        row, at, value = row[hit], at[hit], value[hit]
                    if len(row):
                        ids = batch.slice(first, end - first).select([0, 1]).take(pa.array(row))
                        yield pa.RecordBatch.from_arrays([*ids.columns, pa.array((at - words.first[row]).astype(np.int32)), pa.array(value)], ["doc_id", "twin", "pos", "seed"])

    return run


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (score, first word, end word) in ``text``.

    One array operation a word of the item: a row's gaps along the text follow
    from a running maximum.
    """
    n = len(text)
    ramp = np.arange(n + 1) * GAP
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        step = np.where(text == word, MATCH, -MISMATCH)
        new, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
        diag, up = row[:-1] + step, row[1:] - GAP
        take = diag >= up
        new[1:], start[1:] = np.where(take, diag, up), np.where(take, begin[:-1], begin[1:])
        dead = new <= 0
        new[dead], start[dead] = 0, np.arange(n + 1)[dead]
        lift = new + ramp
        top = np.maximum.accumulate(lift)
        source = np.maximum.accumulate(np.where(lift == top, np.arange(n + 1), 0))
        new, start = top - ramp, start[source]
        row, begin = new, start
        k = int(np.argmax(row))
        if row[k] > best[0]:
            best = (int(row[k]), int(begin[k]), k)
    return best


def passages(item: np.ndarray, text: np.ndarray) -> list[tuple[float, int, int]]:
    """(score, first word, end word) of the passages of ``item`` in ``text`` that reach MIN_SCORE: the best one, then those beside it."""
    found, spans = [], [(0, len(text))]
    while spans:
        lo, hi = spans.pop()
        # No alignment has more matches than the item has words that occur here.
        if np.isin(item, text[lo:hi]).sum() < MIN_SCORE * len(item):
            continue
        best, first, end = align(item, text[lo:hi])
        score = best / (MATCH * len(item))
        if score >= MIN_SCORE:
            found.append((score, lo + first, lo + end))
            spans += [(lo, lo + first), (lo + end, hi)]
    return found


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, hits): hits are (item_id, words, positions in the text)."""
    for batch in batches:
        found: list[tuple] = []
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            words = _words(*tb.string_buffers(one.column(1))).hash.view(np.int64)
            doc = one.column(0)[0].as_py()
            memo: dict[tuple, list[tuple[float, int, int]]] = {}
            for hit in one.column(2)[0].as_py():
                item = np.array(hit["words"], np.int64)
                reach = len(item) + len(item) // 2
                at = np.unique(np.array(hit["positions"]))
                for part in np.split(at, np.flatnonzero(np.diff(at) > reach * APART) + 1):
                    lo, hi = max(0, int(part[0]) - reach), int(part[-1]) + SEED + reach
                    key = (item.tobytes(), lo, hi)
                    if key not in memo:
                        memo[key] = passages(item, words[lo:hi])
                    found += [(doc, hit["item_id"], score, lo + first, lo + end) for score, first, end in memo[key]]
        cols = list(zip(*found, strict=True)) if found else [[]] * 5
        types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "score", "first_word", "end_word"])


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) for each passage of an item found in a text."""
    scratch = Scratch(spark, "decontaminate")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("twin"), "text")
    item = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    seeds = scratch.store(item.mapInArrow(_item_seeds, "item_id long, size int, seed long, words array<long>"), "seeds")
    distinct = seeds.select("seed").distinct()
    count = distinct.count()
    # At most SEED numbers.
    sizes = sorted(r.size for r in seeds.select("size").distinct().collect())
    schema = "doc_id long, twin long, pos int, seed long"
    if count <= MAX_BROADCAST:
        table = spark.sparkContext.broadcast(np.sort(np.array(distinct.toPandas()["seed"], np.int64)))
        hits = text.mapInArrow(_seed_hits(table, sizes), schema) if count else spark.createDataFrame([], schema)
    else:
        hits = text.mapInArrow(_seed_hits(None, sizes), schema).join(distinct, "seed", "left_semi").select("doc_id", "twin", "pos", "seed")
    hits = scratch.store(hits, "hits")
    coded = seeds.select("seed", "item_id", F.xxhash64("words").alias("code"), "words")
    meet = hits.join(coded.select("seed", "item_id", "code").distinct(), "seed").groupBy("doc_id", "twin", "item_id", "code").agg(F.collect_set("pos").alias("positions"))
    names = coded.select("item_id", "code", "words").distinct()
    by_doc = meet.join(names, ["item_id", "code"]).groupBy("doc_id", "twin").agg(F.collect_list(F.struct("item_id", "words", "positions")).alias("hits"))
    found = text.join(by_doc, text.doc_id.eqNullSafe(by_doc.doc_id) & (text.twin == by_doc.twin)).select(text.doc_id, "text", "hits")
    out = found.mapInArrow(_score, "doc_id long, item_id long, score double, first_word int, end_word int")
    return scratch.store(out.distinct(), "passages")
