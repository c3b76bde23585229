"""Fuzzy line deduplication by MinHash.

Lines are the parts of a text between line feeds.  Lines of at least
MIN_CHARS bytes, compared after A-Z lower-casing and without white space at
their ends, are sets of shingles of ``shingle`` bytes.  Equal lines form one class: those
of two equal 64-bit hashes, independent of each other; lines that share the first only stay apart.
Class records meet by banding (BANDS bands of ROWS minwise values: a pair of
similarity 0.75 is missed with probability 0.0015, one of 0.8 with 0.0001; two
records that meet go on if BITS one-bit minwise values agree in ALIKE at least,
which loses one more such pair in 2000), are confirmed by exact Jaccard similarity on their full sets, and distributed
union-find joins them.  Of each component the line of the smallest (doc_id, line number)
stays; the others are removed.  With ``short``, shorter lines that are equal
(compared in the same way) form classes too, of which the first stays; without
it they all stay, as blank lines always do.

op7_line_dedup runs with ``short`` and FINE-byte shingles: one
replaced character then leaves a line of 40 bytes above the threshold, where
with SHINGLE bytes, the default, it takes 63.  Edited lines under MIN_CHARS
bytes are not linked.

Bands meet in buckets: tasks deal the (band, line) entries of a block of text
into arrays by bucket, so that a shuffle moves few rows, and a bucket keeps
of each band the lines that another line of it resembles.  There are as many buckets as it takes
for BUCKET entries each on average; bands that a sample of the lines shows to
hold very many are dealt by line instead, so no bucket holds a large one.

Defined cases: null text stays null, with 0 lines; an empty text is one short
line.  Rows that repeat a doc_id with other texts have lines of their own, of
which those of the smaller line number, then of the smaller hash of the text
count as earlier; rows equal in id and text keep and lose the same lines.  A
null doc_id is never touched.  A very long text or line is handled whole.  An
empty table gives an empty result.  Other columns pass through, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblock as tb
from .common import Scratch
from .nodes import LEAF, leaves, linked

MIN_CHARS = 40
SHINGLE = 8
FINE = 5
PERCENT = 75
ROWS = 4
BANDS = 17
SLOTS = ROWS * BANDS
#: Children of a band that is too large: a pair of similarity 0.75 is in none with probability 0.25 to this power.
KIDS = 4
#: Minwise values, a byte each, of lines that meet others; the least share of equal ones for an exact comparison: 0.75 less 4 standard errors.
SKETCH = 64
LOW = 0.53
#: One-bit values of a line, and how many agree at least: 0.875 of them are expected to at similarity 0.75, half of them by chance.
#: Lines of fewer shingles than BITS have none and go on; so do bands of more than WIDE lines.
BITS, ALIKE, WIDE = 64, 45, 4096
#: Entries of a bucket, and of one hot band's part, on average.
BUCKET = 1 << 18
#: Shingles of neighbouring lines that are signed at once, and bytes of lines that are sketched at once.
STRETCH = 1 << 15
#: One line in so many shows which bands are hot: those of HOT_SEEN sampled lines or more, at most HOT_MAX of them.
SAMPLE, HOT_SEEN, HOT_MAX = 64, 64, 2_000_000


def _line_spans(raw: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, start, end) of every line of ``least`` bytes or more, ends trimmed."""
    if len(raw) == 0:
        return (np.zeros(0, np.int64),) * 4
    text = tb.lower(raw)
    cut = np.flatnonzero(text == 10)
    start = tb.sorted_distinct(np.concatenate([off[:-1], cut + 1]))  # an empty text shares its start with the next one
    start = start[start < len(text)]
    end = np.append(start[1:], len(text))
    row = np.searchsorted(off, start, "right") - 1
    end = end - ((end > start) & (text[np.maximum(end - 1, 0)] == 10))
    number = np.arange(len(start)) - np.searchsorted(start, off[:-1])[row]
    start, end = _trimmed(text, start, end)
    big = end - start >= max(least, 1)
    return row[big], number[big], start[big], end[big]


def _trimmed(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without white space at their ends; what is left empty has no length."""
    start, end = start.copy(), end.copy()
    for _ in range(8):  # most lines have none or little
        lead = np.flatnonzero((start < end) & tb._SPACE[text[np.minimum(start, len(text) - 1)]])
        start[lead] += 1
        tail = np.flatnonzero((start < end) & tb._SPACE[text[np.maximum(end - 1, 0)]])
        end[tail] -= 1
        if len(lead) == 0 and len(tail) == 0:
            return start, end
    solid = np.flatnonzero(~tb._SPACE[text])
    lo, hi = np.searchsorted(solid, start), np.searchsorted(solid, end)
    has = hi > lo
    start[has], end[has] = solid[lo[has]], solid[hi[has] - 1] + 1
    end[~has] = start[~has]
    return start, end


def _shingles(raw: np.ndarray, start: np.ndarray, end: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each span, and where each span's begin; spans come in the order of the text, shingles have eight bytes at most."""
    count = end - start - shingle + 1
    first = np.concatenate([[0], np.cumsum(count)])
    text = np.zeros(len(raw) + 8, np.uint8)
    text[: len(raw)] = tb.lower(raw)
    if len(start) == 0:
        return np.zeros(0, np.uint64), first
    at = np.repeat((start - first[:-1]).astype(np.int32), count) + np.arange(first[-1], dtype=np.int32)
    # Every eight neighbouring bytes as one number, of which the first ones count.
    value = np.ndarray((len(raw),), "<u8", text, strides=(1,))[at]
    if shingle < 8:
        value &= np.uint64((1 << 8 * shingle) - 1)
    value *= tb._Q
    value ^= value >> np.uint64(31)
    value *= tb._P
    return value, first


def _signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One-permutation minwise values of 16 bits: each shingle falls into one slot; empty slots borrow from a full one."""
    rows = len(first) - 1
    key = np.repeat(np.arange(rows, dtype=np.int64) * SLOTS, np.diff(first))
    key += ((value >> np.uint64(32)) * np.uint64(SLOTS) >> np.uint64(32)).astype(np.int64)
    sig = np.full(rows * SLOTS, 0xFFFFFFFF, np.uint32)
    np.minimum.at(sig, key, (value >> np.uint64(20)).astype(np.uint32))
    lack = sig == 0xFFFFFFFF
    at = np.flatnonzero(lack)
    for turn in range(1, 200):
        if len(at) == 0:
            break
        # Each empty slot asks the slots in an order of its own, alike in every line.
        ask = (tb.mix64(np.arange(SLOTS, dtype=np.uint64) * np.uint64(1009) + np.uint64(turn)) % np.uint64(SLOTS)).astype(np.int64)
        slot = at % SLOTS
        asked = at - slot + ask[slot]
        given = ~lack[asked]
        full = at[given]
        sig[full] = sig[asked[given]] ^ np.uint32(turn * 0x9E3779B1 & 0xFFFFFFFF)
        lack[full] = False
        at = at[~given]
    return (sig * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.uint16).reshape(rows, SLOTS)


def _signed(raw: np.ndarray, start: np.ndarray, end: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature and number of shingles of each span, by stretches of the text whose shingles a core's cache holds."""
    count = end - start - shingle + 1
    at = np.concatenate([[0], np.cumsum(count)])
    out, first = np.zeros((len(start), SLOTS), np.uint16), 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(at, at[first] + STRETCH, "right")) - 1)
        lo, hi = start[first:last], end[first:last]
        out[first:last] = _signatures(*_shingles(raw[lo[0] : hi[-1]], lo - lo[0], hi - lo[0], shingle))
        first = last
    return out, count


def _band_nodes(sig: np.ndarray) -> np.ndarray:
    """64-bit hash of each band of each signature: its number and its ROWS values."""
    bands = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    value = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for k in range(ROWS):
        value = (value ^ bands[:, :, k]) * tb._P
        value ^= value >> np.uint64(29)
    return tb.mix64(value)


def _bits(sig: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One 64-bit number a line: the low bits of BITS minwise values; 0, which stands for any, where shingles are few."""
    bits = np.packbits((sig[:, :BITS] & 1).astype(np.uint8), axis=1).view(np.uint64).ravel()
    return np.where(count >= BITS, bits, np.uint64(0))


def _lines(batches: Iterator[pa.RecordBatch], shingle: int, short: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, twin, line, code, check, long, nodes) of each line of (doc_id, twin, text); nodes are the bands of the sampled long lines."""
    for batch in batches:
        for first, end, raw, off in tb.blocks(batch.column(2)):
            row, number, lo, hi = _line_spans(raw, off, 1 if short else MIN_CHARS)
            if len(row) == 0:
                continue
            code, check = tb.span_codes(tb.lower(raw), lo, hi)
            big = hi - lo >= MIN_CHARS
            seen = big & (tb.mix64(code) % np.uint64(SAMPLE) == 0)
            sig, _ = _signed(raw, lo[seen], hi[seen], shingle)
            count = np.concatenate([[0], np.cumsum(seen)]).astype(np.int32) * BANDS
            nodes = pa.ListArray.from_arrays(pa.array(count), pa.array(_band_nodes(sig).view(np.int64).ravel()))
            ids = batch.slice(first, end - first).select([0, 1]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(number.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (code, check)), pa.array(big), nodes], ["doc_id", "twin", "line", "code", "check", "long", "nodes"])


def _entries(batches: Iterator[pa.RecordBatch], shingle: int, buckets: int, hot: Broadcast) -> Iterator[pa.RecordBatch]:
    """(bucket, nodes, recs, bits): the bands of all long lines, dealt by bucket; those of hot bands by line, into buckets below 0.

    Within a bucket the low half of a node's hash stands for it: nodes that
    share it merge, which costs comparisons but never a link.
    """
    often = hot.value
    for batch in batches:
        for _, _, raw, off in tb.blocks(batch.column(0)):
            _, _, lo, hi = _line_spans(raw, off, MIN_CHARS)
            code, _ = tb.span_codes(tb.lower(raw), lo, hi)
            one = np.sort(tb.first_of_each(code)[1])  # shingles are taken in the order of the text
            if len(one) == 0:
                continue
            code = code[one]
            sig, count = _signed(raw, lo[one], hi[one], shingle)
            node, rec, bits = _band_nodes(sig).ravel(), np.repeat(code, BANDS), np.repeat(_bits(sig, count), BANDS)
            bucket = ((node >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            if len(often):
                spot = np.minimum(np.searchsorted(often, node), len(often) - 1)
                bucket = np.where(often[spot] == node, -1 - (tb.mix64(rec ^ node) % np.uint64(buckets)).astype(np.int64), bucket)
            order = np.argsort(bucket.astype(np.int16) if buckets < 1 << 15 else bucket, kind="stable")  # of 16 bits by counting
            bucket = bucket[order]
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            at = pa.array(np.append(cut, len(bucket)).astype(np.int32))
            # A hot node is told from others by its place in the broadcast list.
            name = node[order] & np.uint64(0xFFFFFFFF) if not len(often) else np.where(bucket < 0, np.searchsorted(often, node[order]).astype(np.uint64), node[order] & np.uint64(0xFFFFFFFF))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[cut]), pa.ListArray.from_arrays(at, pa.array(name.astype(np.uint32).view(np.int32))), *(pa.ListArray.from_arrays(at, pa.array(x[order].view(np.int64))) for x in (rec, bits))], ["bucket", "nodes", "recs", "bits"]
            )


def _alike(node: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which entries, sorted by node, another one of their node resembles; all of nodes of more than WIDE."""
    keep = np.zeros(len(node), bool)
    first = np.arange(len(node))
    for step in range(1, WIDE + 1):
        first = first[first + step < len(node)]
        first = first[node[first] == node[first + step]]
        if len(first) == 0:
            break
        a, b = bits[first], bits[first + step]
        near = first[(np.bitwise_count(a ^ b) <= BITS - ALIKE) | (a == 0) | (b == 0)]
        keep[near] = keep[near + step] = True
    else:
        keep |= np.isin(node, node[first])
    return keep


def _meeting(table: pa.Table) -> pa.Table:
    """(node, recs, n) of the nodes of a bucket that hold two alike records or more, a row each; hot nodes, whose records lie in many buckets, have n null."""
    bucket = table.column("bucket")[0].as_py() if table.num_rows else 0
    node, rec, bits = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("nodes", "recs", "bits"))
    order = np.argsort(node)
    if bucket >= 0:
        held = node[order]
        same = held[1:] == held[:-1]
        order = order[np.append(same, False) | np.append(False, same)]
    order = order[np.lexsort((rec[order], node[order]))]
    node, rec, bits = node[order], rec[order], bits[order].view(np.uint64)
    fresh = np.append(True, (node[1:] != node[:-1]) | (rec[1:] != rec[:-1]))[: len(node)]
    node, rec, bits = node[fresh], rec[fresh], bits[fresh]
    if bucket >= 0:
        alike = _alike(node, bits)
        node, rec = node[alike], rec[alike]
    start = np.flatnonzero(np.append(True, node[1:] != node[:-1])[: len(node)])
    end = np.append(start[1:], len(node)) if len(start) else start
    name = tb.mix64(node[start].view(np.uint32).astype(np.uint64) | np.uint64(max(bucket, -1) + 1) << np.uint64(32)).view(np.int64)
    recs = pa.ListArray.from_arrays(pa.array(np.append(start, len(node)).astype(np.int32)), pa.array(rec))
    return pa.table([pa.array(name), recs, pa.array((end - start).astype(np.int64), mask=np.full(len(start), bucket < 0))], names=["node", "recs", "n"])


def _sized(spark: SparkSession, scratch: Scratch, known: DataFrame, long: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The bands that two distinct long lines or more share: (members) of those that are small enough to be compared at once, (node, rec, n) of others."""
    buckets = max(1, -(-long.count() * BANDS // BUCKET))
    sampled = long.where("size(nodes) > 0").select("code", "nodes").dropDuplicates(["code"]).select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    sampled = scratch.store(sampled.where(F.col("n") >= HOT_SEEN), "hot")
    # At most HOT_MAX nodes: each counts for a HOT_MAX-th of the sampled entries or more.
    least = max(HOT_SEEN, buckets * BUCKET // SAMPLE // HOT_MAX)
    hot = np.sort(np.array([r.node for r in sampled.where(F.col("n") >= least).select("node").toLocalIterator()], np.int64).view(np.uint64))
    dealt = known.select("text").mapInArrow(partial(_entries, shingle=shingle, buckets=buckets, hot=spark.sparkContext.broadcast(hot)), "bucket long, nodes array<int>, recs array<long>, bits array<long>")
    met = scratch.store(dealt.groupBy("bucket").applyInArrow(_meeting, "node long, recs array<long>, n long"), "bands")
    small, wide = met.where(F.col("n") <= LEAF).select(F.col("recs").alias("members")), met.select("node", F.explode("recs").alias("rec"), "n")
    large = wide.where(F.col("n") > LEAF)
    if len(hot) == 0:
        return small, large
    wide = wide.where("n is null").select("node", "rec")
    return small, large.unionByName(wide.join(F.broadcast(wide.groupBy("node").agg(F.count("*").alias("n"))), "node").where("n > 1"))


def _branch(node: Column, sig: Column) -> Column:
    """KIDS children of a band that is too large: one more minwise value each, chosen by the node's hash."""
    kids = []
    for k in range(1, KIDS + 1):
        slot = F.pmod(F.xxhash64(node, F.lit(k)), F.lit(SLOTS)).cast("int")
        kids.append(F.xxhash64(node, slot, F.substring(sig, slot * 2 + 1, F.lit(2))))
    return F.array(*kids)


def line_shingles(raw: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle of texts that are one line each."""
    start, end = _trimmed(raw, off[:-1], off[1:])
    long = np.flatnonzero(end - start >= shingle)
    value, first = _shingles(raw, start[long], end[long], shingle)
    return np.repeat(long, np.diff(first)), value


def _pick(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(rec, text, size, sketch, sig) of the wanted lines of each text: columns text, lines, recs, wide.

    sig, what bands that are too large branch by, is made for lines that are ``wide``, which such a band holds.
    """
    for batch in batches:
        rec, out, wide = [], [], []
        for text, lines, recs, large in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            parts = text.split("\n")
            rec += recs
            wide += large
            out += [parts[i] for i in lines]
        picked = pa.RecordBatch.from_arrays([pa.array(rec, pa.int64()), pa.array(out, pa.string())], ["rec", "text"])
        done = []
        for first, end, raw, off in tb.blocks(picked.column(1), 8 * STRETCH):
            row, value = line_shingles(raw, off, shingle)
            starts = np.searchsorted(row, np.arange(end - first + 1))
            sketch = tb.minhash(value, starts, SKETCH).astype(np.uint8)
            # Distinct shingles by one sort: the row before the high bits of the hash.
            kept = tb.sorted_distinct(row.astype(np.uint64) << np.uint64(40) | value >> np.uint64(24))
            part = picked.slice(first, end - first)
            held = np.array(wide[first:end], bool)
            sig = pa.nulls(end - first, pa.binary())
            if held.any():
                made = iter(_signatures(value[held[row]], np.concatenate([[0], np.cumsum(np.diff(starts)[held])])))
                sig = pa.array([next(made).tobytes() if x else None for x in held], pa.binary())
            size = np.diff(np.searchsorted(kept, np.arange(end - first + 1, dtype=np.uint64) << np.uint64(40)))
            done.append(pa.RecordBatch.from_arrays([*part.columns, pa.array(size), pa.array([x.tobytes() for x in sketch], pa.binary()), sig], ["rec", "text", "size", "sketch", "sig"]))
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts (last but one column) without the lines named in the last column, and the counts."""
    for batch in batches:
        texts, gone = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
        clean, total, cut = [], [], []
        for text, lines in zip(texts, gone, strict=True):
            drop = set(lines or ())
            clean.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop) if drop else text)
            total.append(0 if text is None else text.count("\n") + 1)
            cut.append(len(drop))
        kept = [batch.column(i) for i in range(batch.num_columns - 2)]
        arrays = [*kept, pa.array(clean, pa.string()), pa.array(total, pa.int64()), pa.array(cut, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, [f"c{i}" for i in range(len(arrays))])


def repeats(lines: DataFrame) -> DataFrame:
    """Lines equal in code and check to one before them, and ``keep``, the first."""
    rows = lines.select("doc_id", "twin", "line", "code", "check")
    place = F.struct("doc_id", "line", "twin", "check")
    first = rows.groupBy("code", "check").agg(F.min(place).alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, ["code", "check"]).where(place != F.col("keep"))


def dedup_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, short: bool = False) -> tuple[DataFrame, DataFrame]:
    """``docs`` with deduplicated texts and two more columns, and the removed lines.

    The first result has the columns of ``docs`` and n_lines_, n_removed_; the
    second (doc_id, twin, line, keeper_doc, keeper_line) for each removed line,
    where twin is the xxhash64 of the text.
    """
    scratch = Scratch(spark, "lines")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = text.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("twin"), "text")
    every = scratch.store(known.mapInArrow(partial(_lines, shingle=shingle, short=short), "doc_id long, twin long, line int, code long, check long, long boolean, nodes array<long>"), "lines")
    lines = every.where("long")
    reps = scratch.store(lines.groupBy(F.col("code").alias("rec")).agg(F.min(F.struct("doc_id", "line", "twin", "check")).alias("at"), F.count("*").alias("n"), (F.min("check") != F.max("check")).alias("mixed")), "records")
    mark = scratch.mark()
    small, large = _sized(spark, scratch, known, lines, shingle)
    large = scratch.store(large, "nodes")
    met = small.select(F.explode("members").alias("rec"), F.lit(False).alias("wide")).unionByName(large.select("rec", F.lit(True).alias("wide")))
    per_doc = reps.join(met.groupBy("rec").agg(F.max("wide").alias("wide")), "rec").groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.twin").alias("twin"))
    per_doc = per_doc.agg(F.collect_list(F.col("at.line")).alias("lines"), F.collect_list("rec").alias("recs"), F.collect_list("wide").alias("wide"))
    # The lists of lines are put into hash tables: texts need no sort.
    texts = known.join(per_doc.hint("shuffle_hash"), ["doc_id", "twin"]).select("text", "lines", "recs", "wide").mapInArrow(partial(_pick, shingle=shingle), "rec long, text string, size long, sketch binary, sig binary")
    texts = scratch.store_by(texts, "rec", "texts")
    if not texts.groupBy("rec").count().where("count > 1").isEmpty():  # a document that is there twice
        texts = scratch.store_by(texts.dropDuplicates(["rec"]), "rec", "texts")
    leaf, dense = leaves(scratch, large, texts.where("sig is not null").select("rec", "sig"), _branch, 3, large, small)
    comp = linked(scratch, leaf, dense, texts.select("rec", "size", "sketch"), texts.select("rec", "text"), partial(line_shingles, shingle=shingle), PERCENT, LOW, True)
    scratch.drop(mark)
    # Only records that are linked, or occur more than once, have lines to lose.
    joined = comp.select(F.col("node").alias("rec"), "component").unionByName(comp.select(F.col("component").alias("rec"), "component").distinct())
    joined = scratch.store(joined.join(reps.select("rec", "at"), "rec"), "members")
    keeper = joined.groupBy("component").agg(F.min("at").alias("keep"))
    member = joined.join(keeper, "component").select(F.col("rec").alias("code"), F.col("at.check").alias("check"), "keep")
    member = member.unionByName(reps.where("n > 1").join(joined.select("rec"), "rec", "left_anti").select(F.col("rec").alias("code"), F.col("at.check").alias("check"), F.col("at").alias("keep")))
    place = F.struct("doc_id", "line", "twin", "check")
    gone = lines.select("doc_id", "twin", "line", "code", "check").join(member, ["code", "check"]).where(place != F.col("keep"))
    lost = ["doc_id", "twin", "line", "keep"]
    gone = gone.select(lost)
    if not reps.where("mixed").isEmpty():  # other lines of a record's code, told apart by the check, are classes of their own
        odd = lines.join(reps.where("mixed").select(F.col("rec").alias("code"), F.col("at.check").alias("own")), "code").where("check != own")
        gone = gone.unionByName(repeats(odd).select(lost))
    if short:
        gone = gone.unionByName(repeats(every.where("not long")).select(lost))
    gone = scratch.store(gone.select("doc_id", "twin", "line", F.col("keep.doc_id").alias("keeper_doc"), F.col("keep.line").alias("keeper_line")), "removed")
    drop = gone.groupBy("doc_id", "twin").agg(F.collect_set("line").alias("gone_"))  # a document that is there twice names its lines twice
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at, key = names.index(text_col), F.col(f"c{names.index(id_col)}").cast("long")
    joined = plain.join(drop.hint("shuffle_hash"), (key == drop.doc_id) & (F.xxhash64(F.col(f"c{at}").cast("string")) == drop.twin), "left")
    others = [i for i in range(len(names)) if i != at]
    order = [f"c{i}" for i in others]
    fields = ", ".join(f"c{k} {plain.schema[i].dataType.simpleString()}" for k, i in enumerate(others))
    n = len(others)
    schema = f"{fields}{', ' if fields else ''}c{n} string, c{n + 1} bigint, c{n + 2} bigint"
    out = joined.select(*order, F.col(f"c{at}").cast("string").alias("t_"), "gone_").mapInArrow(_cut, schema)
    back = {**{i: k for k, i in enumerate(others)}, at: n}
    out = out.select(*(F.col(f"c{back[i]}").alias(names[i]) for i in range(len(names))), F.col(f"c{n + 1}").alias("n_lines_"), F.col(f"c{n + 2}").alias("n_removed_"))
    return out, gone.distinct()
