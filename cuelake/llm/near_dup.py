"""MinHash near-duplicates by chosen-path set similarity join.

Every document is the set of its distinct 5-word shingles (A-Z lower-cased,
words split at ASCII white space; a shorter text is one shingle).  Documents
with equal sets form one class; the search runs over one document a class.

Search: in each of ``trees`` independent trees the root and every node too
large to compare pick two of the minwise tokens, by the node's own hash, and
branch into one child per token value.  Two sets of similarity 0.75 stay
together down any number of levels with probability 0.88 a tree, so eight
trees miss such a pair with probability 2e-8 but for what the sketches miss.  Small nodes are compared
exhaustively on sketches of one byte a token; the pairs that matter are
confirmed on full sets.

Defined cases: null or empty text, or text without words: empty set, own
component, kept.  Rows that repeat a doc_id are each returned, each with the
component of its own text.  A null doc_id is never linked and is kept.  A very
long text is a block of its own and counts whole.  An empty table gives an empty
result.  Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textblock as tb
from .common import Scratch
from .nodes import leaves, linked

WORDS = 5
PERCENT = 75
#: Minwise tokens a document: the first TOKENS choose paths, one byte of each of SKETCH makes the sketch.
TOKENS = 128
SKETCH = 256
TREES = 8
LEVELS = 7
#: Least share of agreeing sketch bytes for a pair to be confirmed: 0.75 less 3.7 standard errors.
LOW = 0.65


def shingles(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle of each text."""
    row, _, value = tb.Words(raw, off, strong=True).grams(WORDS, short_whole=True)
    return row, value


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, raw, off in tb.blocks(batch.column(1)):
            rows = end - first
            row, _, value = tb.Words(raw, off, strong=True).grams(WORDS, short_whole=True)
            row, value, starts = tb.distinct(row, value, rows)
            count = np.diff(starts)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(tb.mix64(value ^ np.uint64(salt)))]) for salt in (0, 0x5BD1E995)]
            f1, f2 = ((s[starts[1:]] - s[starts[:-1]]).view(np.int64) for s in sums)
            sig = tb.minhash(value, starts, SKETCH)
            tokens = np.ascontiguousarray(sig[:, :TOKENS]).view(np.int32)
            sig_array = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * TOKENS + 1, TOKENS, dtype=np.int32)), pa.array(tokens.ravel()))
            sketch = pa.array([x.tobytes() for x in (sig & 0xFF).astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, rows), pa.array(count.astype(np.int64)), pa.array(f1), pa.array(f2), sig_array, sketch], ["doc_id", "n_shingles", "f1", "f2", "sig", "sketch"]
            )


def _branch(node: Column, sig: Column) -> Column:
    """Two children of a node: its hash picks the tokens, their values name the children."""
    kids = []
    for k in (1, 2):
        slot = F.pmod(F.xxhash64(node, F.lit(k)), F.lit(TOKENS)).cast("int")
        kids.append(F.xxhash64(node, slot, F.element_at(sig, slot + 1)))
    return F.array(*kids)


def _with_record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (rec, f1, text): the rows whose text has the set that f1 stands for."""
    for batch in batches:
        own = pa.chunked_array([x.column("f1") for x in _features([pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["rec", "text"])])])
        same = own.to_numpy() == batch.column(1).to_numpy() if batch.num_rows else np.zeros(0, bool)
        yield batch.filter(pa.array(same)).select([0, 2])


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(spark, "neardup")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    feats = scratch.store(texts.mapInArrow(_features, "doc_id long, n_shingles long, f1 long, f2 long, sig array<int>, sketch binary"), "features")
    full = feats.where("n_shingles > 0 and doc_id is not null").withColumn("rec", F.xxhash64("f1", "f2", "n_shingles"))
    klass = scratch.store(full.groupBy("rec").agg(F.min("doc_id").alias("doc_id")), "classes")
    reps = scratch.store(full.join(klass, ["rec", "doc_id"]).dropDuplicates(["rec"]).select("rec", "doc_id", "f1", F.col("n_shingles").alias("size"), "sig", "sketch"), "records")
    mark = scratch.mark()
    roots = F.array(*(F.xxhash64(F.lit(t), F.lit("tree")) for t in range(TREES)))
    nodes = reps.select(F.explode(F.array_distinct(F.flatten(F.transform(roots, lambda r: _branch(r, F.col("sig")))))).alias("node"), "rec")
    leaf, dense = leaves(scratch, nodes, reps, _branch, LEVELS)
    met = leaf.select("rec") if dense is None else leaf.select("rec").unionByName(dense.select("rec"))
    wanted = texts.join(reps.select("rec", "doc_id", "f1").join(met.distinct(), "rec", "left_semi"), "doc_id").select("rec", "f1", "text")
    if not feats.groupBy("doc_id").count().where("count > 1").isEmpty():
        wanted = wanted.mapInArrow(_with_record, "rec long, text string").dropDuplicates(["rec"])
    wanted = scratch.store(wanted.select("rec", "text"), "texts")
    comp = linked(scratch, leaf, dense, reps.select("rec", "size", "sketch"), wanted, shingles, PERCENT, LOW)
    scratch.drop(mark)
    member = scratch.store(klass.join(comp.withColumnRenamed("node", "rec"), "rec", "left").select("rec", "doc_id", F.coalesce("component", "rec").alias("component")), "members")
    first = member.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    member = member.join(first, "component").select("rec", "component_id")
    out = feats.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.xxhash64("f1", "f2", "n_shingles")).alias("rec"))
    out = out.join(member, "rec", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
