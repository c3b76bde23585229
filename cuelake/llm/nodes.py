"""Comparison of records that meet in small nodes of a similarity search.

A search (chosen paths, banding) puts records into nodes.  This module splits
nodes that are too large, compares each small node exhaustively on compact
sketches, confirms the pairs that matter on full sets, and returns components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblock as tb
from .common import Scratch
from .components import components, merged

#: A node of at most so many records is compared exhaustively.
LEAF = 400
#: A larger node doesn't branch again up to this size; what is left of it to compare is cut into parts of this size.
FEW = 4 * LEAF
#: Shingles of the records of a leaf that are compared exactly with those of another run, or their own, in one row.
RUN = 1 << 17
#: Pairs beside its spanning forest, a record, that a leaf names in the first pass; a leaf of more is compared again in the second.
REST = 4


def leaves(scratch: Scratch, nodes: DataFrame, signatures: DataFrame, branch: Callable[[Column, Column], Column], levels: int, sized: DataFrame | None = None, ready: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(leaf, rec): small groups of records to compare; and (node, rec, n) of the nodes that stay large.

    ``nodes`` has (node, rec).  Nodes of one record vanish; nodes over LEAF
    branch again by ``branch(node, sig)``, an array of child nodes, for at most
    ``levels`` levels.  A large node that keeps more than half of its parent's
    records is dense: branching would not thin it out.  Dense nodes, nodes of
    at most FEW records and what is large on the last level stay as they are
    and are left to ``linked``.  ``sized``, if given, is (node, rec, n) of the
    first level's nodes of two records or more; ``ready``, if given, has further nodes, (members) with their
    records sorted, of LEAF records at most: they meet no other node, so nothing of them is grouped again.
    """
    done = dense = None
    for level in range(levels):
        if level or sized is None:
            sizes = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
            sized = nodes.join(sizes, "node")
        if "above" not in sized.columns:
            sized = sized.withColumn("above", F.lit(None).cast("long"))
        sized = scratch.store(sized, "nodes")
        small = sized.where(F.col("n") <= LEAF).select("node", "rec")
        done = small if done is None else done.unionByName(small)
        big = sized.where(F.col("n") > LEAF)
        if big.isEmpty():
            break
        stuck = F.lit(True) if level == levels - 1 else (F.col("n") <= FEW) | F.coalesce(F.col("n") * 2 > F.col("above"), F.lit(False))
        full = big.where(stuck).select("node", "rec", "n")
        dense = full if dense is None else dense.unionByName(full)
        nodes = big.where(~stuck).join(signatures.select("rec", "sig"), "rec").select(F.explode(F.array_distinct(branch(F.col("node"), F.col("sig")))).alias("node"), "rec", F.col("n").alias("above"))
    sets = done.groupBy("node").agg(F.sort_array(F.collect_list("rec")).alias("members")).select("members")
    sets = (sets if ready is None else sets.unionByName(ready)).distinct()
    return scratch.store(sets.select(F.xxhash64("members").alias("leaf"), F.explode("members").alias("rec")), "leaves"), dense


def _samples(dense: DataFrame) -> DataFrame:
    """(leaf, rec): each large node dealt into blocks of about LEAF records, one row a record."""
    block = F.pmod(F.xxhash64("node", "rec"), F.ceil(F.col("n") / LEAF).cast("long"))
    return dense.select(F.xxhash64("node", block).alias("leaf"), "rec")


def _across(dense: DataFrame, component: DataFrame) -> DataFrame:
    """(leaf, rec): of each large node, what its largest component lacks meets all of it.

    Nodes that are one component by now vanish.  Of the others every record
    outside the largest component is in a leaf with every record of the node;
    pairs within the largest component need no comparison.
    """
    rows = dense.join(component.withColumnRenamed("node", "rec"), "rec", "left").select("node", "rec", "n", F.coalesce("component", "rec").alias("component"))
    parts = rows.groupBy("node", "component").agg(F.count("*").alias("k"))
    top = parts.groupBy("node").agg(F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    rows = rows.join(top.select("node", "top"), "node")
    outer, every = (F.ceil(x / FEW).cast("long") for x in (F.col("n") - F.col("top.k"), F.col("n")))
    own = F.pmod(F.xxhash64("rec", "node"), outer)
    outside = rows.where("component <> top.component").select("node", "rec", own.alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), every - 1)).alias("q"))
    others = rows.select("node", "rec", F.explode(F.sequence(F.lit(0).cast("long"), outer - 1)).alias("p"), F.pmod(F.xxhash64("node", "rec"), every).alias("q"))
    return outside.unionByName(others).select(F.xxhash64("node", "p", "q").alias("leaf"), "rec").distinct()


#: Bytes of sketches that are compared at once.
_BLOCK = 1 << 21


def _agreement(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Share of the bytes in which each sketch of ``some`` agrees with each of ``others``."""
    same = (some[:, None] == others[None]).view(np.uint64)  # eight truth values a number
    return np.bitwise_count(same).sum(axis=2, dtype=np.int32) / some.shape[1]


class _Leaves:
    """The leaves of one batch of (rows, ...): their records' columns as arrays over all leaves."""

    def __init__(self, column: pa.ListArray):
        self.flat, at = column.flatten(), column.offsets.to_numpy()
        self.ends = at - at[0]
        self.rec, self.size, self.group = (self.flat.field(x).to_numpy(zero_copy_only=False) for x in ("rec", "size", "component"))
        self.sketch = tb.string_buffers(self.flat.field("sketch"))[0].reshape(len(self.rec), -1) if len(self.rec) else None

    def likely(self, low: float, percent: int, joined: bool) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(leaf, its first and end row, i, j, agreement), for leaves of three records or more: pairs that sketches and sizes do not rule out and that are not yet connected.

        ``joined`` says that some may be connected.
        """
        big = np.flatnonzero(np.diff(self.ends) > 2)
        for number, first, end in zip(big.tolist(), self.ends[big].tolist(), self.ends[big + 1].tolist(), strict=True):
            group, n = self.group[first:end], end - first
            order, outside = np.arange(n), n
            if joined:
                # Records outside the leaf's largest component come first: pairs within it need no look.
                values, counts = np.unique(group, return_counts=True)
                if counts.max() > 1:
                    inside = group == values[np.argmax(counts)]
                    order, outside = np.argsort(inside, kind="stable"), int(n - inside.sum())
            size, group, sketch = self.size[first:end][order], group[order], self.sketch[first:end][order]
            found, step = [], max(1, _BLOCK // (n * sketch.shape[1]))
            for lo in range(0, min(outside, n - 1), step):
                hi = min(lo + step, outside)
                near = _agreement(sketch[lo:hi], sketch[lo:])
                a, b = size[lo:hi, None], size[None, lo:]
                # Each pair once: of two rows of the block the later one is the other.
                fits = (near >= low) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (np.arange(hi - lo)[:, None] < np.arange(n - lo))
                if joined:
                    fits &= group[lo:hi, None] != group[None, lo:]
                i, j = np.nonzero(fits)
                if len(i):
                    found.append((order[lo + i], order[lo + j], near[i, j]))
            if found:
                yield number, first, end, *(np.concatenate(x) for x in zip(*found, strict=True))

    def couples(self, low: float, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The records of the leaves of two that sketches and sizes do not rule out."""
        i = self.ends[:-1][np.diff(self.ends) == 2]
        if len(i) == 0:
            return self.rec[:0], self.rec[:0]
        near = np.bitwise_count((self.sketch[i] == self.sketch[i + 1]).view(np.uint64)).sum(axis=1, dtype=np.int32) / self.sketch.shape[1]
        i = i[(near >= low) & (100 * np.minimum(self.size[i], self.size[i + 1]) >= percent * np.maximum(self.size[i], self.size[i + 1]))]
        return self.rec[i], self.rec[i + 1]


def _spanning(low: float, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """First pass: (a, b, first) of the likely pairs of each leaf; ``first`` for those of a maximum spanning forest, the most likely to be links.

    A leaf that has many other pairs gives its forest and, in place of them, its own name as a, with b null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_in = _Leaves(batch.column(0))
            i, j = found_in.couples(low, percent)
            out_a, out_b, forest, again = [np.minimum(i, j)], [np.maximum(i, j)], [np.ones(len(i), bool)], []
            for number, first, end, i, j, near in found_in.likely(low, percent, False):
                rec = found_in.rec[first:end]
                parent, keep = list(range(len(rec))), []
                for k in np.argsort(-near, kind="stable"):
                    a, b = int(i[k]), int(j[k])
                    while parent[a] != a:
                        parent[a] = a = parent[parent[a]]
                    while parent[b] != b:
                        parent[b] = b = parent[parent[b]]
                    if a != b:
                        parent[b] = a
                        keep.append(k)
                        if len(keep) == len(rec) - 1:
                            break
                of_forest = np.zeros(len(i), bool)
                of_forest[keep] = True
                if len(i) - len(keep) > REST * len(rec):
                    again.append(batch.column(1)[number].as_py())
                    i, j, of_forest = i[keep], j[keep], of_forest[keep]
                i, j = rec[i], rec[j]
                out_a.append(np.minimum(i, j))
                out_b.append(np.maximum(i, j))
                forest.append(of_forest)
            a, b, of_forest = (np.concatenate(x) for x in (out_a, out_b, forest))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(of_forest)], ["a", "b", "first"])
            yield pa.RecordBatch.from_arrays([pa.array(again, pa.int64()), pa.nulls(len(again), pa.int64()), pa.array([False] * len(again), pa.bool_())], ["a", "b", "first"])

    return run


def _open_pairs(low: float, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Second pass: the pairs of each leaf whose records are not yet connected.

    A pair is taken in the first only of the leaves that hold both.  A leaf's
    records are cut into runs of about RUN shingles; each two runs make a row:
    the records with pairs, and the pairs as places among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, part, recs, pairs = [], [], [], []
            found_in = _Leaves(batch.column(0))
            for number, first, end, i, j, _ in found_in.likely(low, percent, True):
                here, held = batch.column(1)[number].as_py(), [set(x) for x in found_in.flat.field("leaves").slice(first, end - first).to_pylist()]
                mine = np.array([min(held[a] & held[b]) == here for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)
                i, j = i[mine], j[mine]
                rec = found_in.rec[first:end]
                run_of = np.cumsum(found_in.size[first:end]) // RUN
                cell = np.unique(run_of, return_inverse=True)[1]
                cell = cell[i] * len(rec) + cell[j]
                for c in np.unique(cell):
                    ends = np.stack([i[cell == c], j[cell == c]], axis=1)
                    used, place = np.unique(ends, return_inverse=True)
                    leaf.append(here)
                    part.append(int(c))
                    recs.append(rec[used])
                    pairs.append(place.astype(np.uint16).tobytes())
            if leaf:
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(part, pa.int64()), pa.array(recs, pa.list_(pa.int64())), pa.array(pairs, pa.binary())], ["leaf", "part", "recs", "pairs"])

    return run


def _shared(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair of bit sets."""
    out, step = np.zeros(len(i), np.int64), max(1, (16 << 20) // max(1, bits.shape[1] * 8))
    for k in range(0, len(i), step):
        out[k : k + step] = np.bitwise_count(bits[i[k : k + step]] & bits[j[k : k + step]]).sum(axis=1, dtype=np.int64)
    return out


def confirm_cells(cells: DataFrame, texts: DataFrame, shingles: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], percent: int) -> DataFrame:
    """The links (a, b) among the pairs of each row of ``_open_pairs``, by exact similarity of full sets.

    Each record's text comes once a row and its set is made once; a pair costs one intersection of bit sets.
    """
    members = cells.select("leaf", "part", F.posexplode("recs").alias("place", "rec")).join(texts, "rec")
    members = members.groupBy("leaf", "part").agg(F.sort_array(F.collect_list(F.struct("place", "rec", "text"))).alias("rows"))
    both = members.join(cells.select("leaf", "part", "pairs"), ["leaf", "part"]).select("rows", "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, pairs in zip(batch.column(0), batch.column(1), strict=True):
                rec, n = rows.values.field("rec").to_numpy(zero_copy_only=False), len(rows.values)
                row, value, starts = tb.distinct(*shingles(*tb.string_buffers(rows.values.field("text"))), n)
                order = np.argsort(value)
                fresh = np.append(True, np.diff(value[order].view(np.int64)) != 0)[: len(order)]
                token = np.empty(len(order), np.int64)
                token[order] = np.cumsum(fresh) - 1
                often = np.bincount(token) > 1  # others are in no intersection
                place = (np.cumsum(often) - 1)[token]
                common = often[token]
                held = np.zeros((n, -(-int(often.sum()) // 64) * 64), bool)
                held[row[common], place[common]] = True
                bits, size = np.packbits(held, axis=1).view(np.uint64), np.diff(starts)
                i, j = np.frombuffer(pairs.as_py(), np.uint16).reshape(-1, 2).astype(np.int64).T
                shared = _shared(bits, i, j)
                union = size[i] + size[j] - shared
                links = (100 * shared >= percent * union) & (union > 0)
                a, b = rec[i[links]], rec[j[links]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


#: The low bits of a key, which hold the row of a slice of 256.
_ROW = np.int64(255)


def _keys(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Distinct (value, row) as one sorted number each: 56 bits of the value and 8 of the row."""
    return tb.sorted_distinct(value.view(np.int64) & ~_ROW | row)


def confirm(pairs: DataFrame, texts: DataFrame, shingles: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    ``texts`` has (rec, text); ``shingles(bytes, offsets)`` gives the
    (row, hash) of every shingle of each text, repeats included.
    """
    # Pairs are narrow, and a record has few: they are put into hash tables, and texts need no sort to be met the first time.
    both = pairs.hint("shuffle_hash").join(texts.select(F.col("rec").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("rec").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sides = [_keys(*shingles(*tb.string_buffers(part.column(k)))) for k in (2, 3)]
                size = [np.bincount(x & _ROW, minlength=part.num_rows) for x in sides]
                keys = np.sort(np.concatenate(sides))
                shared = np.bincount(keys[1:][keys[1:] == keys[:-1]] & _ROW, minlength=part.num_rows)
                union = size[0] + size[1] - shared
                yield part.select([0, 1]).filter(pa.array((100 * shared >= percent * union) & (union > 0)))

    return both.mapInArrow(run, "a long, b long")


def linked(
    scratch: Scratch,
    leaf: DataFrame,
    dense: DataFrame | None,
    sketches: DataFrame,
    texts: DataFrame,
    shingles: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]],
    percent: int,
    low: float,
    narrow: bool = False,
) -> DataFrame:
    """(node, component) of records linked through any chain of confirmed pairs.

    ``leaf`` and ``dense`` come from ``leaves``.  ``sketches`` has (rec, size, sketch); ``size`` is that of the full set;
    ``narrow`` says that it holds few records beside those of the nodes.
    Two passes: spanning pairs of the leaves, and of blocks dealt from the large nodes, first, which contract a group of
    copies to one component in a number of rows that grows with the group, not with its square; then every remaining
    pair between records that those have not connected, of large nodes too.  Most leaves have few likely pairs and name
    them all in the first pass, so only leaves of many and large nodes are compared again.  Pairs are confirmed on full
    sets, those that the first pass names pair by pair, the rest leaf by leaf.  The result is a stored table.
    """
    first = leaf if dense is None else leaf.unionByName(_samples(dense))
    if not narrow:
        sketches = scratch.store(sketches.join(first.select("rec").distinct(), "rec", "left_semi"), "sketches")

    def groups(rows: DataFrame, fields: list[str]) -> DataFrame:
        out = rows.join(sketches, "rec").groupBy("leaf").agg(F.collect_list(F.struct(*fields)).alias("rows"))
        return out.where("size(rows) > 1").select("rows", "leaf")

    fields = ["rec", "component", "size", "sketch"]
    likely = groups(first.withColumn("component", F.col("rec")), fields).mapInArrow(_spanning(low, percent), "a long, b long, first boolean")
    likely = scratch.store(likely.groupBy("a", "b").agg(F.max("first").alias("first")), "pairs")
    links = scratch.store(confirm(likely.where("first").select("a", "b"), texts, shingles, percent), "links")
    so_far = components(scratch, links)
    ends = [so_far.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in ("a", "b")]
    others = likely.where("not first and b is not null").select("a", "b").join(ends[0], "a", "left").join(ends[1], "b", "left")
    others = others.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    more = confirm(others, texts, shingles, percent)
    again = likely.where("b is null").select(F.col("a").alias("leaf"))
    if dense is not None or not again.isEmpty():
        # What is left to compare: leaves of many likely pairs that hold more than one component, and the large nodes.
        second = leaf.join(again, "leaf", "left_semi")
        second = second if dense is None else second.unionByName(_across(dense, so_far))
        second = second.join(so_far.withColumnRenamed("node", "rec"), "rec", "left").withColumn("component", F.coalesce("component", "rec"))
        open_ = second.groupBy("leaf").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("leaf")
        second = scratch.store(second.join(open_, "leaf"), "open")
        held = second.groupBy("rec").agg(F.collect_set("leaf").alias("leaves"))
        cells = groups(second.join(held, "rec"), [*fields, "leaves"]).mapInArrow(_open_pairs(low, percent), "leaf long, part long, recs array<long>, pairs binary")
        cells = scratch.store(cells, "cells")
        more = more.unionByName(confirm_cells(cells, texts, shingles, percent))
    return scratch.store(merged(scratch, so_far, scratch.store(more, "links")), "components")
