"""Connected components of an edge table by alternating star contractions.

Each round is two joins on node keys with partial aggregation, so that no
component is ever gathered in one place.  Partitions contract their own edges
first, which ends most small components before the first shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars around its smallest nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    for batch in batches:
        for a, b in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])


def components(scratch: Scratch, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link to a smaller node.

    ``edges`` has long columns ``a`` and ``b``.  ``component`` is the smallest
    node reachable.  A node that is absent from the result is its own
    component.  Self loops and repeated edges are allowed, nulls are ignored;
    an empty table gives an empty result.
    """
    e = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    e = e.where("a is not null and b is not null and a <> b").mapInArrow(_contract, "a long, b long")
    e = scratch.store(e, "edges")
    for _ in range(max_rounds):
        # Stars at last: every member has one centre, which is nobody's member.
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = scratch.store(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "stars")
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))


def merged(scratch: Scratch, so_far: DataFrame, more: DataFrame) -> DataFrame:
    """``so_far``, a result of ``components``, after the links (a, b) of ``more``.

    Only the components that ``more`` links are contracted, each as one node.
    """
    if more.isEmpty():
        return so_far
    ends = [so_far.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in ("a", "b")]
    lifted = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    top = components(scratch, lifted).withColumnsRenamed({"node": "inner", "component": "outer"})
    moved = so_far.join(top, F.col("component") == F.col("inner"), "left").select("node", F.coalesce("outer", "component").alias("component"))
    return moved.unionByName(top.select(F.col("inner").alias("node"), F.col("outer").alias("component")))
